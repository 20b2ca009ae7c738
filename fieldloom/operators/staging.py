"""Staged tables and running totals of the engine."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stage(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its lineage, by a checkpoint in the folder of ``spark.checkpoint.dir``."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, made the checkpoints' folder."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path or _own_dir(sc))
    return (path or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


class Shelf:
    """A table that grows by parts, as Parquet in the shared folder; ``by`` are columns that later reads pick parts by."""

    def __init__(self, spark: SparkSession, name: str, schema: str, by: list[str]):
        self.spark, self.schema, self.by, self.empty = spark, schema, by, True
        self.path = f"{shared_dir(spark)}/shelves/{name}-{uuid.uuid4().hex}"

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").partitionBy(*self.by).parquet(self.path)
        self.empty = False

    def table(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema) if self.empty else self.spark.read.schema(self.schema).parquet(self.path)


def _own_dir(sc) -> str:
    """A folder for local sessions, such as those of the tests; a cluster has to name a shared one."""
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints/engine"


def prefix_sums(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over all rows that come earlier in ``order``.

    Rows are dealt by ranges of the order; each range is summed alone, and the few range totals give each its base.
    """
    ranged = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy("__range").agg(F.sum(value).alias("__sum"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = totals.select("__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return ranged.join(F.broadcast(bases), "__range").withColumn("before", F.col("__base") + own).drop("__range", "__base")
