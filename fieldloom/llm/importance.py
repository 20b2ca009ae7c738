"""Target-distribution importance resampling: documents drawn by how much their words look like a target's.

Two passes over whole texts in Arrow batches. First each partition counts its features by bucket (np.bincount, a vector of
``buckets`` numbers), and treeReduce adds the vectors of all partitions, so the driver is handed one. The gains, a vector
of the same length, are broadcast; the second pass gathers them by bucket and sums them by document, by a bincount with
weights. Highest scores are drawn by ranges of scores, so that no task sorts the whole table.

Features are the words of a text, lower case, letters and digits and whatever lies beyond ASCII, and runs of up to ``ngram``
of them. Scores are the sums of gains and a Gumbel number from the id: the highest scores are a sample without
replacement, by importance.

Defined results: a null or empty text has no feature, weight 0 and no rank; a null id takes the Gumbel number of the empty
string, and comes after all ids among equal scores; repeated rows have one score each, and are ranked one after another;
an empty table gives no rows, and an empty target gives every bucket the gain of no count; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.staging import prefix_sums
from .common import Scratch

BUCKETS = 10_000
#: Everything but letters and digits ends a word; capitals become small letters. Bytes beyond ASCII stay.
WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if b > 127 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
#: Features whose buckets a worker remembers, and bytes of text that are counted together.
MEMO, TOGETHER = 500_000, 1 << 20


class _Buckets(dict):
    """Bucket of a feature; starts anew when full, so that memory stays bounded."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        got = zlib.crc32(word) % self.buckets
        if len(word) <= 64:
            self[word] = got
        return got


def features(raw: bytes, ngram: int) -> list[bytes]:
    words = raw.translate(WORDS).split()
    out = words
    for n in range(2, ngram + 1):
        out = out + [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)]
    return out


def _in_chunks(column: pa.Array, memo: _Buckets, ngram: int):
    """(buckets of all features, features of each text, words of each text) for some texts at a time."""
    texts = column.cast(pa.binary())
    at = 0
    while at < len(texts):
        found: list[int] = []
        sizes, words, size = [], [], 0
        while at < len(texts) and size < TOGETHER:
            raw = texts[at].as_py() or b""
            size += len(raw)
            got = features(raw, ngram)
            sizes.append(len(got))
            words.append(len(got) if ngram == 1 else len(raw.translate(WORDS).split()))
            found += map(memo.__getitem__, got)
            at += 1
        yield np.array(found, np.int64), np.array(sizes, np.int64), np.array(words, np.int64)


def bucket_counts(table: DataFrame, text_col: str = "text", buckets: int = BUCKETS, ngram: int = 1) -> np.ndarray:
    """Features by bucket over all rows: a vector of ``buckets`` numbers, whatever the size of the table."""

    def count(batches):
        total, memo = np.zeros(buckets, np.int64), _Buckets(buckets)
        for batch in batches:
            for found, _, _ in _in_chunks(batch.column(0), memo, ngram):
                total += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    spark = table.sparkSession
    vectors = table.select(F.col(text_col).alias("text")).mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(bytes(r[0]), np.int64))
    none = spark.sparkContext.parallelize([np.zeros(buckets, np.int64)], 1)
    return vectors.union(none).treeReduce(np.add, depth=3)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, by bucket, rounded down."""
    s, t = source.astype(float), target.astype(float)
    k = float(len(s))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def gumbel(id_col: Column, seed: int) -> Column:
    """Thousandths of a Gumbel number from the id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, buckets: int = BUCKETS, ngram: int = 1, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; ``rank`` counts the drawn ones from 1, the others have none."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "importance")
    gain = gains(bucket_counts(docs, text_col, buckets, ngram), bucket_counts(target, target_col, buckets, ngram))
    sent = spark.sparkContext.broadcast(gain)

    def weigh(batches):
        memo, gain = _Buckets(buckets), sent.value.astype(float)
        for batch in batches:
            parts = list(_in_chunks(batch.column(1), memo, ngram))
            sums = [np.bincount(np.repeat(np.arange(len(n)), n), gain[found], len(n)) for found, n, _ in parts]
            n, words, weight = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([p[1] for p in parts], [p[2] for p in parts], sums))
            columns = [batch.column(0), pa.array(n.astype(np.int64)), pa.array(words.astype(np.int64)), pa.array(np.rint(weight).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_features", "n_words", "weight"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    weighed = plain.mapInArrow(weigh, "doc_id long, n_features long, n_words long, weight long")
    # a number of each row's own, so that repeated rows are parted by ranges too
    weighed = weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id())
    weighed = scratch.table(weighed, "weighed")
    able = weighed.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    order = able.select("doc_id", "n_features", "weight", "score", "row", (-F.col("score")).alias("last"), F.col("doc_id").isNull().alias("unnamed"), F.lit(1).alias("one"))
    placed = prefix_sums(order, ["last", "unnamed", "doc_id", "row"], "one").withColumn("at", F.col("before") + 1)
    rank = F.when(F.col("at") <= drawn, F.col("at").cast("long"))
    rest = weighed.where(F.col("n_words") < least_words)
    out = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*out, rank.alias("rank")).unionByName(rest.select(*out, F.lit(None).cast("long").alias("rank")))
