"""Substring dedup, importance resampling and the prefix trie against brute force, on odd rows and on small ranges."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import importance, prefix_trie, queries, substring_dedup
from fieldloom.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# ---- substring dedup


def _brute_words(texts, length):
    """(words, removed, kept hash) of each text."""
    words = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[k : k + length]) for w in words for k in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = True
        out.append((len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def test_fm_index_counts_like_a_scan():
    r = np.random.default_rng(1)
    for symbols, n in ((2, 40), (5, 200), (9, 300)):
        s = np.concatenate([[0], r.integers(1, symbols, n), [0], r.integers(1, symbols, n // 2), [0]])
        text = "".join(chr(65 + x) for x in s)
        tree = substring_dedup.WaveletTree(s, symbols)
        for c in range(symbols):
            at = np.arange(len(s) + 1)
            assert (tree.rank(np.full(len(at), c), at) == np.concatenate([[0], np.cumsum(s == c)])).all()
        length = 7
        ends = np.array([e for e in range(length + 1, len(s)) if 0 not in s[e - length : e]])
        for e, got in zip(ends, substring_dedup.FMIndex(s, symbols, length).matching(s, ends, length)):
            want = max([k for k in range(1, length + 1) if text.find(text[e - k : e]) != text.rfind(text[e - k : e])], default=0)
            assert got == want


@pytest.mark.parametrize("many", [1, 128])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, many):
    """Few words, so that grams meet in many surroundings; copies, repeats inside a text, passages at their edges."""
    monkeypatch.setattr(substring_dedup, "MANY", many)
    r = np.random.default_rng(2)
    word = lambda n: " ".join(f"w{x}" for x in r.integers(0, 4000, n))
    line, passage = word(12), word(50)
    texts = [word(60) + "\n" + line + "\t" + word(60) for _ in range(30)]
    texts += [f"{word(20)} {passage} {word(20)}" for _ in range(6)] + [texts[0]] * 5 + [word(34), None, "", "a " * 80, f"{passage} x {passage}"]
    texts += [" ".join(passage.split()[:k]) + " " + word(40) for k in (34, 35, 36)]
    got = substring_dedup.dedup(_docs(spark, list(enumerate(texts))), 35).collect()
    want = _brute_words(texts, 35)
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == dict(enumerate(want))
    assert sum(w[1] for w in want) > 500


def test_substring_dedup_on_odd_rows(spark):
    shared = " ".join(f"x{k}" for k in range(40))
    rows = [(None, "a " + shared, "q"), (7, "b " + shared, "q"), (7, "c " + shared + " d", None), (None, None, None), (8, "long " * 30_000, "z"), (9, "é😀 漢字 " * 40, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, span string").withColumn("h", F.lit(1)).withColumn("gram", F.lit("x"))
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.dedup(df, 35).collect())
    assert got == [(0, 0, 0), (0, 41, 40), (7, 41, 40), (7, 42, 40), (8, 30_000, 30_000), (9, 80, 80)]
    assert substring_dedup.dedup(df.limit(0), 35).count() == 0


# ---- importance resampling


def _brute_scores(docs, target, percent, least, seed, ngram=1):
    def grams(t):
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = "".join(c if ord(c) > 127 or c in "0123456789abcdefghijklmnopqrstuvwxyz" else " " for c in text).split(" ")
        w = [x for x in w if x]
        return w, [" ".join(w[k : k + n]) for n in range(1, ngram + 1) for k in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = collections.Counter(), collections.Counter()
    for _, d in docs:
        s.update(map(bucket, grams(d)[1]))
    for d in target:
        t.update(map(bucket, grams(d)[1]))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10_000) / ((s[b] + 1) * (nt + 10_000))))
    out = {}
    for i, d in docs:
        w, g = grams(d)
        weight = sum(gain(bucket(f)) for f in g)
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)]
    able = sorted((i for i in out if out[i][4] >= least), key=lambda i: (-out[i][2], i))
    for k, i in enumerate(able[: len(able) * percent // 100]):
        out[i][3] = k + 1
    return {i: tuple(v[:4]) for i, v in out.items()}


@pytest.mark.parametrize("ngram", [1, 2])
def test_importance_equals_brute_force(spark, ngram):
    docs = [(r.doc_id, r.text) for r in queries.documents(spark, SF).collect()] + [(9_001, None), (9_002, ""), (9_003, "Ünï Cödé " * 30), (9_004, "a\x00b\x7fc " * 20)]
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = importance.resample(_docs(spark, docs), target, 30, 20, 2024, ngram=ngram).collect()
    want = _brute_scores(docs, [r.text for r in target.collect()], 30, 20, 2024, ngram)
    assert {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in got} == want and len(got) == len(want)


def test_importance_on_odd_rows(spark):
    text = "one two three four five " * 6
    rows = [(1, text, "x")] * 4 + [(None, text, None)] * 3 + [(2, None, "y"), (3, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("weight", F.lit("w")).withColumn("row", F.lit(1))
    target = spark.createDataFrame([(1, "one two"), (2, None)], "item_id long, text string")
    got = importance.resample(df, target, 100, 20, 2024).collect()
    assert len(got) == 9 and sorted(r.rank for r in got if r.rank) == list(range(1, 8))
    assert all(r.rank is None and r.weight == 0 for r in got if r.doc_id in (2, 3))
    assert importance.resample(df.limit(0), target).count() == 0
    assert len({r.weight for r in importance.resample(df, target.limit(0)).collect() if r.doc_id == 1}) == 1


# ---- prefix trie


def _brute_trie(rows):
    """Nodes of the rebuilt conversations by dictionaries of prefixes."""
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + t[h:]
    members = collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(built[c]) == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _trie(df, **kwargs):
    return sorted(map(tuple, prefix_trie.trie(df, **kwargs).collect()), key=str)


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("segment,ranges", [(64, 8), (3, 8), (2, 40), (1, 5)])
def test_trie_equals_brute_force(spark, segment, ranges):
    """Copies, common beginnings, conversations inside others, long ones; borders of ranges and segments everywhere."""
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = np.random.default_rng(segment)
        rows = []
        for c in [*range(95, 130), *range(200, 240), 512, 1_001, -7, -100]:
            n = int(r.integers(1, 9)) if c != 207 else 30
            same = c % 3 == 0
            rows += [(c, k, "user" if k % 2 else "assistant", f"t{k}" if same and k < 7 else f"t{k}-{r.integers(0, 2)}" + "x" * int(r.integers(0, 2))) for k in range(n)]
        df = spark.createDataFrame(rows, CONV).repartition(5)
        assert _trie(df, segment=segment, chunk=2) == _brute_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_trie_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert _trie(df) == _brute_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_trie_on_odd_rows(spark):
    rows = [(100, None, None, "a"), (100, 1, "u", None), (100, 1, "u", None), (101, 5, "u", "b"), (None, 1, "u", "c"), (350, 0, "u", "q"), (400, 2, None, "a"), (400, -1, "", "x" * 100_000)]
    df = spark.createDataFrame(rows, CONV).withColumn("key", F.lit(1)).withColumn("c", F.lit("x")).withColumn("pos", F.lit(0))
    assert _trie(df) == _brute_trie(rows)
    assert prefix_trie.trie(df.limit(0)).count() == 0
    assert _trie(df.where("conv_id = 350")) == _brute_trie(rows[5:6])


def test_running_sums_split_keys(spark):
    df = spark.range(0, 2_000).select((F.col("id") % 3 == 0).cast("long").alias("c"), F.col("id").alias("v"))
    got = prefix_trie.running(df, "c", [F.col("v")], {"s": F.col("v"), "n": F.lit(1).cast("long")}, Scratch(spark, "test"), "t").collect()
    for key in (0, 1):
        at = total = 0
        for r in sorted((r for r in got if r.c == key), key=lambda r: r.v):
            assert (r.n, r.s) == (at, total)
            at, total = at + 1, total + r.v
