"""Text tables, rasters and weight files, read and written through Spark."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.kriging import Kriging, apply, points_of, weight_rows
from ..operators.staging import prefix_sums

#: Lines that begin with one of these are comments (fixed values).
COMMENTS = "#!*"
WEIGHTS_VERSION = 2
#: Buckets of stored weights by their source.
BUCKETS = 64


def read_points(spark: SparkSession, path: str, columns: list[str], id_column: str = "obs_id") -> DataFrame:
    """A list-directed text table: comment and blank lines, a header line, then an integer id and reals, parted by commas or
    blanks. Columns go by place; lines with fewer fields have nulls, further fields are left out, and so are lines that do
    not begin with an integer, such as the header."""
    lines = spark.read.text(path).select(F.trim(F.translate("value", "\t\r", "  ")).alias("text"))
    rows = lines.where("text <> ''").where(~F.substring("text", 1, 1).isin(*COMMENTS))
    fields = F.split(F.regexp_replace("text", r"\s*,\s*|\s+", ","), ",")
    number = lambda i: F.regexp_replace(F.get(fields, F.lit(i)), "[dD]", "E").try_cast("double")
    out = rows.select(F.get(fields, F.lit(0)).try_cast("long").alias(id_column), *(number(i + 1).alias(c) for i, c in enumerate(columns)))
    return out.where(F.col(id_column).isNotNull())


def read_values(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """(place from 1, value) of a file of numbers, in the file's order, however many stand in a line; words such as a header's are
    left out. Lines are ordered by the offset of their part of the file and their place in it."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("offset"), F.monotonically_increasing_id().alias("line"))
    rows = lines.where(~F.substring(F.trim("value"), 1, 1).isin(*COMMENTS))
    words = rows.select("file_path", "offset", "line", F.posexplode(F.split(F.trim(F.regexp_replace("value", r"[\s,]+", " ")), " ")).alias("__at", "word"))
    numbers = words.select("file_path", "offset", "line", "__at", F.regexp_replace("word", "[dD]", "E").try_cast("double").alias(name), F.lit(1).alias("one")).where(F.col(name).isNotNull())
    return prefix_sums(numbers, ["file_path", "offset", "line", "__at"], "one").select((F.col("before") + 1).cast("long").alias("place"), name)


def write_points(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Comma-separated values with a header."""
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).csv(path)


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """An ESRI ASCII grid as points (block_id from 1 by rows from the top, row, col, x, y of cell centres, value; no-data: null).

    Lines are read side by side; a running count of their numbers gives each its cell. The header, a few words of each file,
    is one row a file.
    """
    lines = spark.read.text(path).select("_metadata.file_path", F.col("_metadata.file_block_start").alias("offset"), F.monotonically_increasing_id().alias("line"), F.array_remove(F.split(F.trim("value"), r"\s+"), "").alias("w"))
    first = F.lower(F.get("w", F.lit(0)))
    named = lines.where(first.rlike("^[a-z]")).withColumn("name", first)
    entry = lambda name: F.max(F.when(F.col("name") == name, F.get("w", F.lit(1)).cast("double")))
    names = ("ncols", "nrows", "cellsize", "nodata_value", "xllcorner", "yllcorner", "xllcenter", "yllcenter")
    head = named.groupBy("file_path").agg(*(entry(n).alias(n) for n in names))
    corner = lambda axis: F.coalesce(F.col(f"{axis}llcorner") + F.col("cellsize") / 2, F.col(f"{axis}llcenter"))
    head = head.select("file_path", F.col("ncols").cast("long").alias("ncols"), F.col("nrows").cast("long").alias("nrows"), F.col("cellsize").alias("cell"), F.col("nodata_value").alias("gap"), corner("x").alias("x0"), corner("y").alias("y0"))
    body = lines.where(~F.coalesce(first.rlike("^[a-z]"), F.lit(True))).withColumn("n", F.size("w"))
    placed = prefix_sums(body, ["file_path", "offset", "line"], "n")
    begin = placed.groupBy("file_path").agg(F.min("before").alias("begin"))
    cells = placed.join(F.broadcast(begin), "file_path").select("file_path", (F.col("before") - F.col("begin")).alias("from"), F.posexplode("w").alias("i", "text"))
    cells = cells.withColumn("k", (F.col("from") + F.col("i")).cast("long")).join(F.broadcast(head), "file_path").where(F.col("k") < F.col("ncols") * F.col("nrows"))
    row, value = F.floor(F.col("k") / F.col("ncols")), F.col("text").cast("double")
    return cells.select((F.col("k") + 1).alias("block_id"), row.cast("int").alias("row"), (F.col("k") % F.col("ncols")).cast("int").alias("col"), (F.col("x0") + (F.col("k") % F.col("ncols")) * F.col("cell")).alias("x"), (F.col("y0") + (F.col("nrows") - 1 - row) * F.col("cell")).alias("y"), F.when(value.eqNullSafe(F.col("gap")), None).otherwise(value).alias("value"))


def _places(obs: DataFrame, k: Kriging) -> str:
    """A digest of the observations' numbers and places, in any order."""
    rows = points_of(obs.withColumn("value", F.lit(0.0)), k).select(F.xxhash64("var_id", "src_id", *k.dims, "err").cast("decimal(20,0)").alias("h"))
    r = rows.agg(F.count("*").alias("n"), F.sum("h").alias("s")).first()
    return f"{r.n}:{r.s}"


def _made_by(k: Kriging) -> str:
    return hashlib.sha256(k.describe().encode()).hexdigest()


@dataclass(frozen=True)
class WeightStore:
    """Stored weights: ``blocks`` by block, and ``rows`` in buckets by source, so that a replay of one variable shuffles the values to
    them; of several, if the session does not ask for all keys (spark.sql.requireAllClusterKeysForCoPartition)."""

    manifest: Row
    blocks: DataFrame
    rows: DataFrame

    def replay(self, obs: DataFrame, k: Kriging, targets: DataFrame | None = None) -> DataFrame:
        """Estimates from other values of the same observations; ValueError where these lie elsewhere."""
        if self.manifest.observations and self.manifest.observations != _places(obs, k):
            raise ValueError("these weights were made for other observations")
        return apply(self.blocks, obs, k, targets, self.rows)


def write_weights(table: DataFrame, path: str, k: Kriging, obs: DataFrame | None = None) -> None:
    """A weight table as Parquet, by block and in buckets by source, with a manifest: counts, configuration, and a digest of the
    observations. Each write goes to a folder of its own; the manifest is written last, one row, and makes it the valid one."""
    spark, made = table.sparkSession, uuid.uuid4().hex
    root = f"{path}/{made}"
    table.write.parquet(f"{root}/blocks")
    blocks = spark.read.parquet(f"{root}/blocks")
    name = f"weights_{made}"
    weight_rows(blocks).write.bucketBy(BUCKETS, "src_id").sortBy("src_id").option("path", f"{root}/rows").saveAsTable(name)
    counts = (blocks.count(), spark.table(name).count())
    spark.sql(f"drop table {name}")  # its files stay
    search = str(k.search if not isinstance(k.search, dict) else sorted(k.search.items()))
    entry = (WEIGHTS_VERSION, made, *counts, k.nvar, list(k.dims), k.unbiased, k.standard, search, _made_by(k), _places(obs, k) if obs is not None else None)
    schema = "version int, folder string, blocks long, weights long, nvar int, dims array<string>, unbiased boolean, standard boolean, search string, made_by string, observations string"
    spark.createDataFrame([entry], schema).withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def weight_store(spark: SparkSession, path: str, k: Kriging) -> WeightStore:
    """The newest complete weights, if they were made by this configuration; else ValueError."""
    m = spark.read.parquet(f"{path}/manifest").orderBy(F.desc("at")).first()
    if m.version != WEIGHTS_VERSION or m.made_by != _made_by(k):
        raise ValueError("these weights were made for another configuration")
    blocks = spark.read.parquet(f"{path}/{m.folder}/blocks")
    name, where = f"weights_{m.folder}", f"{path}/{m.folder}/rows"
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(where).schema)
    spark.sql(f"create table if not exists {name} ({columns}) using parquet clustered by (src_id) sorted by (src_id) into {BUCKETS} buckets location '{where}'")
    return WeightStore(m, blocks, spark.table(name))


def read_weights(spark: SparkSession, path: str, k: Kriging, obs: DataFrame | None = None) -> DataFrame:
    """The table by block, if it was made by this configuration, and, where they are given, for these observations; else ValueError."""
    store = weight_store(spark, path, k)
    if obs is not None and store.manifest.observations and store.manifest.observations != _places(obs, k):
        raise ValueError("these weights were made for other observations")
    return store.blocks
