"""Space-time covariances: sum-metric and product-sum, from a spatial and a temporal model."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rotation import squared_length, transformed
from .variogram import Structure, Variogram, model_name, rho, rho_values


@dataclass(frozen=True)
class TimeTransform:
    """Joint distance of a time lag: 0 at lag 0, else nugget + sill * (1 - rho(lag / at)), never negative."""

    model: str = "lin"
    nugget: float = 0.0
    sill: float = 1.0
    at: float = 1.0

    def __call__(self, dt: np.ndarray) -> np.ndarray:
        dt = np.abs(dt)
        out = self.nugget + self.sill * (1 - rho_values(self.model, dt / self.at))
        return np.where(dt <= np.finfo(float).eps, 0.0, np.maximum(out, 0.0))

    def column(self, dt: Column) -> Column:
        out = self.nugget + self.sill * (1 - rho(self.model, F.abs(dt) / self.at))
        return F.when(F.abs(dt) <= float(np.finfo(float).eps), 0.0).otherwise(F.greatest(out, F.lit(0.0)))


@dataclass(frozen=True)
class SpaceTimeVariogram:
    """``kind`` sum_metric: Cs(h) + Ct(t) + sum of joint sills times the spatial shapes at sqrt(h^2 + f(t)^2);
    product_sum: k * Cs * Ct + Cs + Ct. The last component of a lag is time."""

    space: Variogram
    time: Variogram
    kind: str = "sum_metric"
    joint_sills: tuple[float, ...] = ()
    transform: TimeTransform = TimeTransform()
    k: float = 0.0

    def __post_init__(self):
        if self.kind not in ("sum_metric", "product_sum"):
            raise ValueError(f"unknown space-time model: {self.kind!r}")
        if self.joint_sills and len(self.joint_sills) != len(self.space.structures):
            raise ValueError("one joint sill for each spatial structure")

    def check(self, ndim: int) -> None:
        self.space.check(ndim - 1)

    def _joint(self) -> list[tuple[float, Structure]]:
        return [(sill, s) for sill, s in zip(self.joint_sills, self.space.structures) if model_name(s.model) != "nug"]

    def at_zero(self) -> float:
        cs, ct = self.space.at_zero(), self.time.at_zero()
        if self.kind == "product_sum":
            return self.k * cs * ct + cs + ct
        return cs + ct + sum(sill for sill, _ in self._joint())

    def covariance(self, lags: np.ndarray) -> np.ndarray:
        h, dt = lags[..., :-1], lags[..., -1]
        cs, ct = self.space.covariance(h), self.time.covariance(np.abs(dt)[..., None])
        if self.kind == "product_sum":
            return self.k * cs * ct + cs + ct
        f = self.transform(dt)
        return cs + ct + sum((sill * rho_values(s.model, np.sqrt(s.relative(h) ** 2 + f * f)) for sill, s in self._joint()), np.zeros(dt.shape))

    def covariance_column(self, lags: list[Column]) -> Column:
        """The same as a column of lag components, time last."""
        h, dt = lags[:-1], lags[-1]
        cs, ct = self.space.covariance_column(h), self.time.covariance_column([F.abs(dt)])
        if self.kind == "product_sum":
            return self.k * cs * ct + cs + ct
        f, out = self.transform.column(dt), cs + ct
        for sill, s in self._joint():
            out = out + sill * rho(s.model, F.sqrt(squared_length(transformed(s.matrix(len(h)), h)) + f * f))
        return out

    def describe(self) -> str:
        return f"{self.kind}\nspace\n{self.space.describe()}\ntime\n{self.time.describe()}\njoint sills {self.joint_sills} at {self.transform.at} k {self.k}"
