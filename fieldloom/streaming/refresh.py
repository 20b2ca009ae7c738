"""Estimates from a stream of observation values, by weights solved before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.kriging import Kriging, apply, weight_rows

#: Parts of the index from observations to blocks; a batch reads those of its observations.
PARTS = 64


def _part(c: str):
    return F.pmod(F.xxhash64(c), F.lit(PARTS)).cast("int").alias("part")


def write_index(table: DataFrame, path: str) -> None:
    """Which blocks read an observation: (src_id, block_id), in parts by the observation."""
    rows = weight_rows(table).where("kind = 0").select("src_id", "block_id").distinct()
    rows.select("*", _part("src_id")).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def latest(values: DataFrame, known: DataFrame) -> DataFrame:
    """``known`` observations with the newest of ``values`` (obs_id, value, at) in place of theirs."""
    newest = values.groupBy("obs_id").agg(F.max_by("value", "at").alias("__new"))
    return known.join(newest, "obs_id", "left").withColumn("value", F.coalesce("__new", "value")).drop("__new")


def refresh(stream: DataFrame, table: DataFrame, known: DataFrame, k: Kriging, sink, checkpoint: str, **trigger) -> StreamingQuery:
    """For each micro-batch of (obs_id, value, at): estimates of the blocks that it touches go to ``sink(estimates, batch_id)``.

    The stream's state keeps the newest value of each observation by ``at``, so a late older value changes nothing, and a restart goes
    on where it was. What changed is also written under ``checkpoint`` by batch, a repeated batch over itself; estimates are made
    from ``known`` values and all changes up to the batch. Touched blocks come from an index by observation.
    """
    spark = table.sparkSession
    index, changes = f"{checkpoint}/index", f"{checkpoint}/changes"
    write_index(table, index)
    schema = f"obs_id {known.schema['obs_id'].dataType.simpleString()}, value double, at {stream.schema['at'].dataType.simpleString()}"
    newest = stream.groupBy("obs_id").agg(F.max_by("value", "at").cast("double").alias("value"), F.max("at").alias("at"))

    def batch(changed: DataFrame, batch_id: int) -> None:
        here = f"{changes}/batch={batch_id}"
        changed.select("obs_id", "value", "at").write.mode("overwrite").parquet(here)
        now = spark.read.schema(schema).parquet(here)
        past = spark.read.schema(f"{schema}, batch long").parquet(changes).where(F.col("batch") <= batch_id)
        asked = now.select(F.col("obs_id").alias("src_id"), _part("obs_id")).distinct()
        touched = spark.read.parquet(index).join(asked, ["part", "src_id"], "left_semi").select("block_id").distinct()
        sink(apply(table.join(touched, "block_id", "left_semi"), latest(past, known), k), batch_id)

    writer = newest.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/stream")
    return writer.trigger(**(trigger or {"availableNow": True})).start()
