"""Normal scores: cumulative probabilities of distributed values, forward and back transform with tails.

Everything is made of built-in columns; the tables of distinct values are never collected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.brackets import bracketed, interpolated
from ..operators.staging import prefix_sums

#: Probabilities closer to 0 or 1 than this are moved there before the inverse is taken.
EDGE = 1e-12
#: Fixed values of published rational approximations in double precision, from the constant term upwards. The inverse (Wichura's
#: AS 241) has one pair for the middle, |p - 1/2| <= 0.425, and two for the tails; the distribution function one pair.
MIDDLE = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3), (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
NEAR_TAIL = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4), (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
FAR_TAIL = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7), (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)
BELOW = (220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 0.0352624965998911), (440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 0.0883883476483184)


def _ratio(pair: tuple, x):
    top, bottom = (sum_up(c, x) for c in pair)
    return top / bottom


def sum_up(coefficients: tuple, x):
    """A polynomial of arrays or columns."""
    out = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        out = x * out + c
    return out


def cdf(y: np.ndarray) -> np.ndarray:
    y = np.asarray(y, float)
    a = np.minimum(np.abs(y), 37.0)
    far = a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))
    below = np.exp(-a * a / 2) * np.where(a < 7.07106781186547, _ratio(BELOW, a), 1 / (far * 2.506628274631))
    return np.where(np.isnan(y), y, np.where(y > 0, 1 - below, below))


def inverse(p: np.ndarray) -> np.ndarray:
    p = np.clip(np.asarray(p, float), EDGE, 1 - EDGE)
    q = p - 0.5
    r = np.sqrt(-np.log(np.minimum(p, 1 - p)))
    tail = np.where(r <= 5, _ratio(NEAR_TAIL, r - 1.6), _ratio(FAR_TAIL, r - 5))
    return np.where(np.abs(q) <= 0.425, q * _ratio(MIDDLE, 0.180625 - q * q), np.sign(q) * tail)


def _cdf_of(y: Column, a: Column) -> Column:
    far = a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))
    below = F.exp(-a * a / 2) * F.when(a < 7.07106781186547, _ratio(BELOW, a)).otherwise(1 / (far * 2.506628274631))
    return F.when(y.isNull() | F.isnan(y), y).when(y > 0, 1 - below).otherwise(below)


def normal_cdf(y: Column | str) -> Column:
    y = F.col(y) if isinstance(y, str) else y
    return _cdf_of(y, F.least(F.abs(y), F.lit(37.0)))


def _clipped(p: Column) -> Column:
    return F.when(p.isNotNull(), F.greatest(F.least(p, F.lit(1 - EDGE)), F.lit(EDGE)))


def _inverse_of(p: Column, r: Column) -> Column:
    """``r`` is the root of the logarithm of the nearer tail's probability, taken negative."""
    q = p - 0.5
    tail = F.when(r <= 5, _ratio(NEAR_TAIL, r - 1.6)).otherwise(_ratio(FAR_TAIL, r - 5))
    return F.when(F.abs(q) <= 0.425, q * _ratio(MIDDLE, 0.180625 - q * q)).otherwise(F.signum(q) * tail)


def normal_inverse(p: Column | str) -> Column:
    p = _clipped(F.col(p) if isinstance(p, str) else p)
    return _inverse_of(p, F.sqrt(-F.log(F.least(p, 1 - p))))


def with_inverse(df: DataFrame, p: Column | str, name: str) -> DataFrame:
    """``df`` with the inverse as a column, by steps of their own: polynomials of columns, not of expressions."""
    steps = df.withColumn("__c", _clipped(F.col(p) if isinstance(p, str) else p)).withColumn("__r", F.sqrt(-F.log(F.least(F.col("__c"), 1 - F.col("__c")))))
    return steps.withColumn(name, _inverse_of(F.col("__c"), F.col("__r"))).drop("__c", "__r")


def score_table(values: DataFrame, value: str = "value", weight: str | None = None) -> DataFrame:
    """(z, p): each distinct value and its midpoint cumulative probability; ``weight`` declusters. Null values are left out.

    Ties are summed before any shuffle, and running totals are taken by ranges of values, so no task sorts the whole table.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    ties = values.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("z")).agg(F.sum(w).alias("w"))
    running = prefix_sums(ties, ["z"], "w")
    total = running.agg(F.sum("w").alias("total"))
    return running.join(F.broadcast(total)).select("z", ((F.col("before") + F.col("w") / 2) / F.col("total")).alias("p"))


def scores(values: DataFrame, table: DataFrame, value: str = "value") -> DataFrame:
    """``values`` with ``score``, the normal score of values that the table was built from."""
    placed = values.join(table.withColumnRenamed("z", "__z"), F.col(value).cast("double") == F.col("__z"), "left")
    return with_inverse(placed, "p", "score").drop("__z", "p")


def forward(values: DataFrame, table: DataFrame, value: str = "value") -> DataFrame:
    """``values`` with ``score`` for any values: probabilities along the lines between the table's, the ends' beyond them."""
    p = interpolated(F.col(value).cast("double"), "key", "p")
    return bracketed(values, table, value, "z", ["p"]).transform(with_inverse, p, "score").drop("low", "high")


@dataclass(frozen=True)
class Tails:
    """Extrapolation beyond the least and greatest value: linear, power, or (upper only) hyperbolic."""

    zmin: float | None = None
    zmax: float | None = None
    lower: str = "linear"
    upper: str = "linear"
    lower_power: float = 1.0
    upper_power: float = 1.0


def back(scored: DataFrame, table: DataFrame, tails: Tails = Tails(), score: str = "score", value: str = "value") -> DataFrame:
    """``scored`` with ``value`` from normal scores: along the lines between the table's values, and by ``tails`` beyond them.

    The table's ends are one row; everything else is a bracket search by ranges. Null scores, and an empty table, give null.
    """
    t = tails
    probable = scored.withColumn("__a", F.least(F.abs(F.col(score)), F.lit(37.0))).withColumn("__p", _cdf_of(F.col(score), F.col("__a"))).drop("__a")
    ends = table.agg(F.min("z").alias("__z0"), F.max("z").alias("__z1"), F.min("p").alias("__p0"), F.max("p").alias("__p1"))
    placed = bracketed(probable, table, "__p", "p", ["z"]).join(F.broadcast(ends))
    q, low, high, p0, p1 = (F.col(c) for c in ("__p", "__z0", "__z1", "__p0", "__p1"))
    zmin = low if t.zmin is None else F.least(F.lit(float(t.zmin)), low)
    zmax = high if t.zmax is None else F.greatest(F.lit(float(t.zmax)), high)
    share = F.greatest(q / p0, F.lit(0.0))
    below = zmin + (F.pow(share, F.lit(t.lower_power)) if t.lower == "power" else share) * (low - zmin)
    over = F.greatest((q - p1) / (1 - p1), F.lit(0.0))
    above = high + (F.pow(over, F.lit(t.upper_power)) if t.upper == "power" else over) * (zmax - high)
    if t.upper == "hyperbolic":
        above = F.when(high > 0, F.pow((1 - p1) * F.pow(high, F.lit(t.upper_power)) / F.greatest(1 - q, F.lit(EDGE)), F.lit(1 / t.upper_power))).otherwise(high + over * (zmax - high))
    found = F.when(q <= p0, below).when(q >= p1, above).otherwise(interpolated(q, "key", "z"))
    found = F.when(q.isNotNull(), F.least(F.greatest(found, zmin), zmax))
    return placed.withColumn(value, found).drop("low", "high", "__p", "__z0", "__z1", "__p0", "__p1")


def indicator(category: Column, label) -> Column:
    return (category == F.lit(label)).cast("double")
