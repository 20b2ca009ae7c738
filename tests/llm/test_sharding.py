import zlib

import numpy as np

from fieldloom.llm import queries, sharding


def _sizes(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard(docs, 8).toPandas()
    assert len(rows) == len(texts)
    return rows.groupby("shard")["size"].sum(), rows.groupby("text_crc32").shard.nunique().max()


def test_copies_of_a_third_of_the_bytes_leave_eight_shards(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 5000, int(n))) for n in 2 ** rng.uniform(0, 13, 300)]
    copied = " ".join(f"w{k}" for k in rng.integers(0, 5000, 600))
    for part in (0.34, 0.45):
        copies = int(part / (1 - part) * sum(map(len, texts)) / len(copied))
        sizes, places = _sizes(spark, texts + [copied] * copies)
        assert list(sizes.index) == list(range(8)) and places == 1
        assert sizes.sort_values().iloc[:-1].max() <= 1.25 * sizes.min()


def test_fewer_texts_than_shards(spark):
    sizes, places = _sizes(spark, ["a b c"] * 5 + ["d e", None, None])
    assert list(sizes.index) == [0, 1, 2] and places == 1


def test_shards_of_the_table_are_leaves_of_median_cuts(spark):
    """Every row as a loop has it, and each cut of the tree: along the widest dimension, about in the middle of the bytes."""
    docs = queries.documents(spark, "/root/testdata/sf0.001")
    rows = queries.op1_sharding(spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id")
    for r in docs.collect():
        raw = (r.text or "").encode()
        assert (rows.loc[r.doc_id, "size"], rows.loc[r.doc_id, "text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert sorted(rows.shard.unique()) == list(range(8)) and set(rows.law) == {"bytes"} and rows.grown_shard.isna().all()
    for _, part in rows.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    meta = sharding.metadata(docs).toPandas().set_index("doc_id").join(rows[["shard"]])
    dims = [c for c in meta.columns if c.startswith("d_")]

    def cut(part, low, high):
        if high - low == 1:
            return
        middle = (low + high) // 2
        left, right = part[part.shard < middle], part[part.shard >= middle]
        extent = part[dims].max() - part[dims].min()
        parted = [d for d in dims if left[d].max() <= right[d].min()]
        assert parted and any(extent[d] == extent.max() for d in parted)
        assert abs(left["size"].sum() - part["size"].sum() / 2) <= max(part["size"].max(), 0.05 * part["size"].sum())
        cut(left, low, middle)
        cut(right, middle, high)

    cut(meta, 0, 8)
