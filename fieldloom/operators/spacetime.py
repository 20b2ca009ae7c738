"""Space-time kriging: the same pipeline with time as last dimension and a space-time covariance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spacetime import SpaceTimeVariogram
from .kriging import Kriging, estimate
from .neighbours import Search


def time_column(at, unit_seconds: float = 86_400.0) -> Column:
    """A timestamp as a number of units since the epoch."""
    return F.unix_micros(at) / (1e6 * unit_seconds)


def spacetime(vgm: SpaceTimeVariogram | dict, dims: tuple[str, ...] = ("x", "y", "t"), nmax: int = 16, time_at: float = 1.0, **kwargs) -> Kriging:
    """A configuration whose search scales time by ``time_at``; ``search`` arguments such as maxdist go to ``Search``."""
    search = {n: kwargs.pop(n) for n in ("maxdist", "ratio1", "ratio2", "azimuth", "dip", "plunge", "sectors") if n in kwargs}
    return Kriging(vgm, dims, Search(nmax, time_at=time_at, **search), **kwargs)


def spacetime_kriging(obs: DataFrame, targets: DataFrame, vgm: SpaceTimeVariogram, dims: tuple[str, ...] = ("x", "y", "t"), nmax: int = 16, time_at: float = 1.0, nodes: DataFrame | None = None, **kwargs) -> DataFrame:
    """(block_id, estimate, variance) of one variable."""
    return estimate(obs, targets, spacetime(vgm, dims, nmax, time_at, **kwargs), nodes).select("block_id", "estimate", "variance")


def spacetime_cokriging(obs: DataFrame, targets: DataFrame, vgm: dict, nvar: int, dims: tuple[str, ...] = ("x", "y", "t"), nmax: int = 16, time_at: float = 1.0, **kwargs) -> DataFrame:
    """(block_id, var_id, estimate, variance) of several variables."""
    return estimate(obs, targets, spacetime(vgm, dims, nmax, time_at, nvar=nvar, **kwargs))
