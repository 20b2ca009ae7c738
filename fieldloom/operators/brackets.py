"""Bracket search: each query's neighbours among the knots of a sorted table, by ranges of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage


def bracketed(queries: DataFrame, knots: DataFrame, at: str, key: str, values: list[str]) -> DataFrame:
    """``queries`` with ``low`` and ``high``, structs of (key, values): the greatest knot not above ``at``, and the least above it.

    Knots and queries are dealt together by ranges of ``at`` and ``key``; each range looks in itself, and what lies beyond its
    borders comes from one row a range. Queries of one value are spread by a number of their own, so neither the table nor a
    common value is gathered anywhere. Null beyond the ends, and where ``at`` is null; knots with a null key are none.
    """
    knot = F.struct(F.col(key).cast("double").alias("key"), *(F.col(v).cast("double").alias(v) for v in values))
    kind = f"struct<key:double,{','.join(f'{v}:double' for v in values)}>"
    asked = queries.select(F.struct(*queries.columns).alias("__q"), F.col(at).cast("double").alias("__k"), F.lit(1).alias("__kind"), F.monotonically_increasing_id().alias("__salt"), F.lit(None).cast(kind).alias("__knot"))
    there = knots.where(F.col(key).isNotNull()).select(F.lit(None).cast(asked.schema["__q"].dataType).alias("__q"), F.col(key).cast("double").alias("__k"), F.lit(0).alias("__kind"), F.lit(0).cast("long").alias("__salt"), knot.alias("__knot"))
    order = ["__k", "__kind", "__salt"]
    ranged = stage(there.unionByName(asked).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    ends = ranged.groupBy("__range").agg(F.min("__knot").alias("first"), F.max("__knot").alias("last"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    after = Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    borders = ends.select("__range", F.last("last", ignorenulls=True).over(before).alias("__below"), F.last("first", ignorenulls=True).over(after).alias("__above"))
    up = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("__range").orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("low", F.last("__knot", ignorenulls=True).over(up)).withColumn("high", F.last("__knot", ignorenulls=True).over(down))
    placed = placed.where("__kind = 1").join(F.broadcast(borders), "__range")
    known = F.col("__k").isNotNull()
    return placed.select("__q.*", F.when(known, F.coalesce("low", "__below")).alias("low"), F.when(known, F.coalesce("high", "__above")).alias("high"))


def interpolated(at: Column, key: str, value: str) -> Column:
    """Along the line between ``low`` and ``high`` of a bracketed table; the nearest knot's value beyond the ends. ``key`` is
    the name of the struct's field that ``at`` is compared with."""
    a, b = F.col(f"low.{key}"), F.col(f"high.{key}")
    x, y = F.col(f"low.{value}"), F.col(f"high.{value}")
    return F.when(b.isNull(), x).when(a.isNull(), y).otherwise(x + (at - a) / (b - a) * (y - x))
