"""Targets of estimation: regular grids, points, blocks of integration nodes."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Four-point Gauss-Legendre quadrature on an interval of length 1 (fixed values).
ABSCISSAE = (-0.4305681558, -0.1699905218, 0.1699905218, 0.4305681558)
WEIGHTS = (0.1739274226, 0.3260725774, 0.3260725774, 0.1739274226)


def regular_grid(spark: SparkSession, origin: list[float], step: list[float], count: list[int], dims: list[str] | None = None) -> DataFrame:
    """(block_id from 1, coordinates): the first dimension runs fastest."""
    dims = dims or ["x", "y", "z", "t"][: len(origin)]
    total = 1
    for c in count:
        total *= c
    left, columns = F.col("id"), []
    for d, o, s, c in zip(dims, origin, step, count):
        columns.append((F.lit(float(o)) + (left % c) * float(s)).alias(d))
        left = F.floor(left / c)
    return spark.range(total).select((F.col("id") + 1).alias("block_id"), *columns)


def quadrature_nodes(targets: DataFrame, size: list[float], dims: list[str]) -> DataFrame:
    """(block_id, node_id, coordinates, weight): 4 ** n nodes about each centre, of a block of ``size``."""
    if len(size) != len(dims) or min(size) < 0:
        raise ValueError("a block size for each dimension, none negative")
    nodes = []
    for k, at in enumerate(itertools.product(range(4), repeat=len(dims))):
        w = 1.0
        for i in at:
            w *= WEIGHTS[i]
        nodes.append(F.struct(F.lit(k + 1).alias("node_id"), F.lit(w).alias("weight"), *(F.lit(ABSCISSAE[i] * s).alias(f"o{n}") for n, (i, s) in enumerate(zip(at, size)))))
    placed = targets.withColumn("__n", F.explode(F.array(*nodes)))
    return placed.select("block_id", F.col("__n.node_id").alias("node_id"), *((F.col(d) + F.col(f"__n.o{n}")).alias(d) for n, d in enumerate(dims)), F.col("__n.weight").alias("weight"))


def weighted_nodes(nodes: DataFrame) -> DataFrame:
    """User nodes (block_id, node_id, coordinates[, weight]); without weights each of a block's n nodes has 1 / n."""
    if "weight" in nodes.columns:
        return nodes
    n = nodes.groupBy("block_id").agg(F.count("*").alias("__n"))
    return nodes.join(n, "block_id").withColumn("weight", 1.0 / F.col("__n")).drop("__n")


def centroids(nodes: DataFrame, dims: list[str]) -> DataFrame:
    """(block_id, coordinates): weighted means of each block's nodes."""
    w = F.sum("weight")
    return weighted_nodes(nodes).groupBy("block_id").agg(*((F.sum(F.col("weight") * F.col(d)) / w).alias(d) for d in dims))


def duplicate_places(points: DataFrame, dims: list[str]) -> DataFrame:
    """Places that more than one row of one variable has, with their number."""
    by = (["var_id"] if "var_id" in points.columns else []) + dims
    return points.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
