"""What the operators of this subpackage share: reading, staged tables, ranks, hashes."""

from __future__ import annotations

import gc
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one task of a ranking stage handles; the number of chunks follows the row count.
CHUNK_ROWS = 20_000
#: Rows of texts that a Python worker is handed at once, where the session has no smaller number: long texts fill memory.
BATCH_ROWS = 1_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where it is unset and one machine does all the work."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "/tmp/checkpoints/fieldloom"
        sc.setCheckpointDir(path)
    return path.rstrip("/")


class Scratch:
    """Tables of one query, as Parquet in the shared folder, so that lost executors cost no earlier stage."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
        spark.conf.set(rows, min(int(spark.conf.get(rows)), BATCH_ROWS))
        self.root = f"{shared_dir(spark)}/fieldloom/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._tables: list[str] = []

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = self.path(f"{self._n:03d}_{name}")
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        # shuffles of tables written before are unreachable by now; a collection lets their files go
        gc.collect()
        self.spark._jvm.System.gc()
        out.scratch_path = path
        self._tables.append(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later stage reads."""
        for df in tables:
            self._delete(df.scratch_path)

    def keep(self, *tables: DataFrame) -> None:
        """Deletes all tables but these."""
        for path in set(self._tables) - {df.scratch_path for df in tables}:
            self._delete(path)

    def _delete(self, path: str) -> None:
        self._tables.remove(path)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def parts_for(spark: SparkSession, n_bytes: float, target: int = 32 << 20) -> int:
    """A number of partitions: of ``target`` bytes each, and enough for every core."""
    return int(max(spark.sparkContext.defaultParallelism, n_bytes // target + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def dense_rank_rows(df: DataFrame, key: str, order: list[Column], n_rows: int, salt: list[Column], rank: str) -> DataFrame:
    """Gapless ranks from 0 among the rows of each ``key``, without gathering a key in one task.

    Rows of a key are dealt into hashed chunks of about CHUNK_ROWS; a prefix sum over the small table of
    chunk sizes gives each chunk its base, and only rows of one chunk are sorted together.
    """
    chunks = max(1, -(-n_rows // CHUNK_ROWS))
    df = df.withColumn("__chunk", F.pmod(F.xxhash64(*salt), F.lit(chunks)).cast("int"))
    sizes = df.groupBy(key, "__chunk").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(key, "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(key, "__chunk").orderBy(*order)
    return (
        df.join(bases.hint("shuffle_hash"), [key, "__chunk"])
        .withColumn(rank, (F.col("__base") + F.row_number().over(inside) - 1).cast("long"))
        .drop("__chunk", "__base")
    )


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply) over uint64, in a new array."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
