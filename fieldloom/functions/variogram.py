"""Correlation models and nested covariances as columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rotation import squared_length, transform, transformed

#: Names of the models, by their first three letters (fixed values).
MODELS = ("nug", "sph", "exp", "gau", "hol", "pow", "bsq", "cir", "lin", "cyc", "dco")


def model_name(name: str) -> str:
    short = name.strip().lower()[:3]
    if short not in MODELS:
        raise ValueError(f"unknown variogram model: {name!r}")
    return short


def rho(model: str, r: Column) -> Column:
    """Correlation at the lag ``r`` relative to the range; 1 at lag 0."""
    model = model_name(model)
    near = lambda c: F.when(r < 1, c).otherwise(0.0)
    q = F.least(r, F.lit(1.0))
    return {
        "nug": lambda: F.when(r > 0, 0.0).otherwise(1.0),
        "sph": lambda: near(1 - 1.5 * r + 0.5 * r * r * r),
        "exp": lambda: F.exp(-3 * r),
        "gau": lambda: F.exp(-3.0625 * r * r),
        "hol": lambda: F.cos(math.pi * r),
        "pow": lambda: near(1 - F.pow(r, F.lit(1.5))),
        "bsq": lambda: near((1 - r * r) * (1 - r * r)),
        "cir": lambda: near(1 - (2 * q * F.sqrt(1 - q * q) + 2 * F.asin(q)) / math.pi),
        "lin": lambda: near(1 - r),
        "cyc": lambda: F.exp(-2 * F.sin(math.pi * r) * F.sin(math.pi * r)),
        "dco": lambda: F.exp(-3 * r) * F.cos(math.pi * r),
    }[model]()


def rho_values(model: str, r: np.ndarray) -> np.ndarray:
    """The same for arrays, in the solver's batches."""
    model, q = model_name(model), np.minimum(r, 1.0)
    return {
        "nug": lambda: np.where(r > 0, 0.0, 1.0),
        "sph": lambda: 1 - 1.5 * q + 0.5 * q**3,
        "exp": lambda: np.exp(-3 * r),
        "gau": lambda: np.exp(-3.0625 * r * r),
        "hol": lambda: np.cos(np.pi * r),
        "pow": lambda: 1 - q**1.5,
        "bsq": lambda: (1 - q * q) ** 2,
        "cir": lambda: 1 - (2 * q * np.sqrt(1 - q * q) + 2 * np.arcsin(q)) / np.pi,
        "lin": lambda: 1 - q,
        "cyc": lambda: np.exp(-2 * np.sin(np.pi * r) ** 2),
        "dco": lambda: np.exp(-3 * r) * np.cos(np.pi * r),
    }[model]()


@dataclass(frozen=True)
class Structure:
    """One nested structure. ``range`` is the major range; minor ones default to it. ``product`` multiplies the group of
    structures before it in place of being added."""

    model: str
    sill: float
    range: float = 1.0
    nugget: float = 0.0
    minor1: float | None = None
    minor2: float | None = None
    azimuth: float = 0.0
    dip: float = 0.0
    plunge: float = 0.0
    product: bool = False

    def __post_init__(self):
        model_name(self.model)
        if self.range <= 0 or (self.minor1 or 1) <= 0 or (self.minor2 or 1) <= 0:
            raise ValueError("ranges must be positive")

    def matrix(self, ndim: int) -> np.ndarray:
        """From a lag to its length relative to the range; in one dimension the range is the first minor one."""
        first, second = (self.range if m is None else m for m in (self.minor1, self.minor2))
        return transform(ndim, first / self.range, second / self.range, self.azimuth, self.dip, self.plunge) / self.range

    def relative(self, lags: np.ndarray) -> np.ndarray:
        turned = lags @ self.matrix(lags.shape[-1]).T
        return np.sqrt((turned * turned).sum(-1))


def grouped(products: list[bool], parts: list):
    """The sum over groups of the products in each; ``parts``: one value, array or column a structure."""
    groups: list = []
    for product, part in zip(products, parts):
        if product and groups:
            groups[-1] = groups[-1] * part
        else:
            groups.append(part)
    return sum(groups[1:], groups[0]) if groups else 0.0


@dataclass(frozen=True)
class Variogram:
    """Nested structures: a sum of product groups; the nuggets count at lag 0 only."""

    structures: tuple[Structure, ...]

    def __post_init__(self):
        if len(self.structures) > 99:
            raise ValueError("at most 99 structures")

    def add(self, *args, **kwargs) -> Variogram:
        return Variogram((*self.structures, Structure(*args, **kwargs)))

    def times(self, *args, **kwargs) -> Variogram:
        return Variogram((*self.structures, Structure(*args, **kwargs, product=True)))

    def _grouped(self, parts: list):
        return grouped([s.product for s in self.structures], parts)

    def check(self, ndim: int) -> None:
        if ndim == 3 and any(model_name(s.model) == "hol" for s in self.structures):
            raise ValueError("the hole effect is not valid in three dimensions")

    def at_zero(self) -> float:
        return float(self._grouped([s.sill + s.nugget for s in self.structures]))

    def covariance(self, lags: np.ndarray) -> np.ndarray:
        """Of lag vectors (..., ndim)."""
        out = self._grouped([s.sill * rho_values(s.model, s.relative(lags)) for s in self.structures])
        return np.where((lags == 0).all(-1), self.at_zero(), out)

    def covariance_column(self, lags: list[Column]) -> Column:
        """The same as a column of lag components."""
        parts = [F.lit(s.sill) * rho(s.model, F.sqrt(squared_length(transformed(s.matrix(len(lags)), lags)))) for s in self.structures]
        zero = lags[0] == 0
        for lag in lags[1:]:
            zero = zero & (lag == 0)
        return F.when(zero, F.lit(self.at_zero())).otherwise(self._grouped(parts) if parts else F.lit(0.0))

    def describe(self) -> str:
        lines = [f"{'x' if s.product else '+'} {s.model} sill {s.sill} nugget {s.nugget} range {s.range}, {s.minor1 or s.range}, {s.minor2 or s.range} angles {s.azimuth}, {s.dip}, {s.plunge}" for s in self.structures]
        return "\n".join([*lines, f"C(0) = {self.at_zero()}"])


class StackedVariogram:
    """Models of equal kinds with parameters of their own, one a system: arrays over systems for each structure."""

    def __init__(self, kinds: list[tuple[str, bool]], sill: np.ndarray, nugget: np.ndarray, matrix: np.ndarray):
        self.kinds, self.sill, self.nugget, self.matrix = kinds, sill, nugget, matrix

    @classmethod
    def of(cls, rows: list[list[Structure]], ndim: int) -> StackedVariogram:
        kinds = [(model_name(s.model), s.product) for s in rows[0]]
        if ndim == 3 and any(m == "hol" for m, _ in kinds):
            raise ValueError("the hole effect is not valid in three dimensions")
        of = lambda f: np.array([[f(s) for s in row] for row in rows], float)
        return cls(kinds, of(lambda s: s.sill), of(lambda s: s.nugget), of(lambda s: s.matrix(ndim)))

    def take(self, rows: np.ndarray) -> StackedVariogram:
        return StackedVariogram(self.kinds, self.sill[rows], self.nugget[rows], self.matrix[rows])

    def _grouped(self, parts: list):
        return grouped([product for _, product in self.kinds], parts)

    def at_zero(self) -> np.ndarray:
        return self._grouped(list((self.sill + self.nugget).T))

    def covariance(self, lags: np.ndarray) -> np.ndarray:
        """Of lag vectors (systems, rows, columns, ndim)."""
        parts = []
        for k, (model, _) in enumerate(self.kinds):
            turned = np.einsum("bnmd,bed->bnme", lags, self.matrix[:, k])
            parts.append(self.sill[:, k, None, None] * rho_values(model, np.sqrt((turned * turned).sum(-1))))
        return np.where((lags == 0).all(-1), self.at_zero()[:, None, None], self._grouped(parts))
