"""Rotated and scaled lags: the space in which a model or a search is isotropic."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def rotation(azimuth: float = 0.0, dip: float = 0.0, plunge: float = 0.0) -> np.ndarray:
    """3 x 3: plunge about Y after dip about X after azimuth about Z, in degrees. With azimuth 0 the major axis is +Y."""
    turn = np.eye(3)
    for degrees, (a, b) in ((-plunge, (0, 2)), (-dip, (1, 2)), (azimuth, (0, 1))):
        plane = np.eye(3)
        c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
        plane[a, a] = plane[b, b] = c
        plane[a, b], plane[b, a] = -s, s
        turn = turn @ plane
    return turn


def transform(ndim: int, ratio1: float = 1.0, ratio2: float = 1.0, azimuth: float = 0.0, dip: float = 0.0, plunge: float = 0.0) -> np.ndarray:
    """ndim x ndim matrix from coordinates to search space; ``ratio1`` and ``ratio2``: minor ranges by the major one."""
    return (np.diag([1 / ratio1, 1.0, 1 / ratio2]) @ rotation(azimuth, dip, plunge))[:ndim, :ndim]


def transformed(matrix: np.ndarray, columns: list[Column]) -> list[Column]:
    """The product with a coordinate vector, as columns; zero terms are left out, so that no rotation costs nothing."""
    out = []
    for row in matrix.tolist():
        terms = [c if v == 1.0 else c * F.lit(v) for v, c in zip(row, columns) if v != 0.0]
        out.append(sum(terms[1:], terms[0]) if terms else F.lit(0.0))
    return out


def squared_length(columns: list[Column]) -> Column:
    return sum((c * c for c in columns[1:]), columns[0] * columns[0])
