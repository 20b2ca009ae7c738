"""Indicator kriging: a category as one 0/1 variable a label, estimated together and normalised to probabilities."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import indicator
from ..functions.variogram import Structure, Variogram
from .kriging import Kriging, estimate


def labels_of(obs: DataFrame, column: str = "category") -> list:
    """The distinct labels in order: one each, so few by design."""
    return [r[0] for r in obs.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).collect()]


def proportions(obs: DataFrame, column: str = "category") -> DataFrame:
    """(label, proportion) of all rows with a category."""
    counts = obs.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("label", (F.col("n") / F.col("total")).alias("proportion"))


def indicators(obs: DataFrame, labels: list, column: str = "category") -> DataFrame:
    """Observations with var_id (place of the label, from 1) and value 1 or 0 for each label; null categories go."""
    each = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("var_id"), indicator(F.col(column), label).alias("value")) for k, label in enumerate(labels))))
    rest = [c for c in obs.columns if c not in ("var_id", "value", column)]
    return obs.where(F.col(column).isNotNull()).withColumn("__i", each).select(*rest, "__i.var_id", "__i.value")


def indicator_models(structure: Structure, ncat: int, cross: str = "same", shares: list[float] | None = None) -> dict:
    """Models by pair: all alike (same), no cross terms (independent), or sills p(1 - p) and their geometric means
    (proportional). ``shares``: proportions of the labels."""
    if cross not in ("same", "independent", "proportional"):
        raise ValueError(f"unknown cross model: {cross!r}")
    if cross == "proportional" and shares is None:
        raise ValueError("proportional cross models need proportions")
    if shares is not None and len(shares) != ncat:
        raise ValueError("one proportion for each label")
    sills = [p * (1 - p) for p in shares] if shares is not None and cross != "same" else [structure.sill] * ncat
    out = {}
    for i in range(ncat):
        for j in range(i, ncat):
            if i == j:
                sill, nugget = sills[i], structure.nugget
            elif cross == "independent":
                sill, nugget = 0.0, 0.0
            else:
                sill, nugget = (math.sqrt(sills[i] * sills[j]) if cross == "proportional" else structure.sill), structure.nugget
            out[i + 1, j + 1] = Variogram((replace(structure, sill=sill, nugget=nugget),))
    return out


def normalised(estimates: DataFrame, ncat: int) -> DataFrame:
    """Estimates of variables up to ``ncat`` clipped to [0, 1] and divided by their sum in each block, where it is not 0."""
    p = F.when(F.col("var_id") <= ncat, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("estimate")))).otherwise(F.col("estimate"))
    total = F.sum(F.when(F.col("var_id") <= ncat, F.col("p"))).over(Window.partitionBy("block_id"))
    out = estimates.withColumn("p", F.when(F.col("estimate").isNotNull(), p)).withColumn("total", total)
    value = F.when((F.col("var_id") <= ncat) & (F.col("total") > 0), F.col("p") / F.col("total")).otherwise(F.col("p"))
    return out.withColumn("estimate", value).drop("p", "total")


def indicator_kriging(obs: DataFrame, targets: DataFrame, k: Kriging, labels: list | None = None, column: str = "category", covariates: DataFrame | None = None) -> DataFrame:
    """(block_id, var_id, estimate, variance): probability of each label. ``covariates``: further variables, observations
    with var_id above the number of labels, which help to estimate but are no probabilities."""
    labels = labels or labels_of(obs, column)
    data = indicators(obs, labels, column)
    if covariates is not None:
        data = data.unionByName(covariates, allowMissingColumns=True)
    return normalised(estimate(data, targets, k), len(labels))


def most_likely(probabilities: DataFrame, ncat: int) -> DataFrame:
    """(block_id, var_id) of the greatest probability; ties go to the first label."""
    best = F.max_by("var_id", F.struct("estimate", -F.col("var_id")))
    return probabilities.where((F.col("var_id") <= ncat) & F.col("estimate").isNotNull()).groupBy("block_id").agg(best.alias("var_id"))
