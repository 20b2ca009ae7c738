"""Operators and stages on odd rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldloom.llm import bpe, embedding_dedup, lm, minhash, packing, quality_classifier, quality_rules, queries, sharding, suffix_dedup, token_output

SF = "/root/testdata/sf0.001"
BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, h string, row long, key long"
ODD = [
    (1, None, None, None, None, "x", "y", 1, 2),
    (2, "", "en", "a", 0, None, None, None, None),
    (3, "plain words here, and some more of them to have a text that is long enough", "en", "a", 3, "x", "y", 1, 2),
    (3, "plain words here, and some more of them to have a text that is long enough", "en", "a", 3, "x", "y", 1, 2),
    (4, "plain words here, and some more of them to have a text that is long enough", None, "b", 3, "x", "y", 1, 2),
    (5, "long " * 40_000, "de", "b", 5, "x", "y", 1, 2),
    (None, "no id at all but a text nevertheless, and a few words", "en", None, 9, "x", "y", 1, 2),
    (6, "\x0b\x0c \n\t 漢字 é😀 <|endoftext|>", "fr", "c", 7, "x", "y", 1, 2),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


OPERATORS = {
    "sharding": lambda d, _: sharding.shard(d, 8),
    "classifier": lambda d, labels: quality_classifier.classify(d, labels),
    "packing": lambda d, _: packing.packed_documents(d, BYTES, 1, 2048),
    "suffix": lambda d, _: suffix_dedup.dedup(d, 400),
    "bpe": lambda d, _: bpe.digests(d, WORDS),
    "minhash": lambda d, _: minhash.near_duplicates(d),
    "rules": lambda d, _: quality_rules.judged(d),
    "lm": lambda d, _: lm.score(d),
    "tokens": lambda d, _: token_output.token_output(d, BYTES, 0),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(odd, labels, name):
    got = OPERATORS[name](odd, labels).collect()
    if name == "packing":
        assert sum(r.length for r in got if r.doc_id == 3) == 2 * next(r.doc_tokens for r in got if r.doc_id == 3)
        assert len({(r.doc_id, r.start) for r in got}) >= 7
    else:
        assert sorted(r.doc_id or 0 for r in got) == [0, 1, 2, 3, 3, 4, 5, 6]
    assert OPERATORS[name](odd.limit(0), labels).count() == 0


def test_rules_on_odd_rows(odd):
    got = {r.doc_id: r for r in quality_rules.judged(odd).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[2].kept
    assert got[5].n_words == 40_000 and got[5].n_repeat_words == 40_000 and got[5].base_failed
    assert got[6].n_words == 3 and got[3].n_dup_lines == 0


def _base(text):
    """Base counts by plain loops."""
    import re

    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    grams = {}
    for k in range(len(words) - 4):
        grams.setdefault(tuple(words[k : k + 5]), []).append(k)
    covered = {p for at in grams.values() if len(at) > 1 for k in at for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rules_against_loops(spark):
    docs = queries.documents(spark, SF)
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        n, chars, symbols, lines, repeat = _base(r.text or "")
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (n, chars, symbols, lines, repeat)
        assert g.base_failed == (n < 10 or 100 * repeat > 20 * n) and not (g.base_failed and g.kept)


def test_packing_against_the_library(spark):
    docs = queries.documents(spark, SF)
    t = Tokenizer.from_file(BYTES)
    ids = {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    rows = queries.op3_packing(spark, SF).toPandas()
    for doc, part in rows.sort_values("start").groupby("doc_id"):
        assert part.length.sum() == len(ids[doc]) == part.doc_tokens.iloc[0]
        for r in part.itertuples():
            assert zlib.crc32(ids[doc][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, part in rows.sort_values("offset").groupby("sequence_id"):
        assert (part.offset.to_numpy() == np.cumsum(part.length.to_numpy()) - part.length.to_numpy()).all() and part.length.sum() <= 2048
    assert rows.length.sum() > 0.95 * 2048 * rows.sequence_id.nunique()


def test_token_output_against_the_library(spark):
    docs = queries.documents(spark, SF).orderBy("doc_id").collect()
    t = Tokenizer.from_file(BYTES)
    start = 0
    got = queries.op10_token_output(spark, SF).orderBy("doc_id").collect()
    assert len(got) == len(docs)
    for r, d in zip(got, docs):
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_huffman_codes_are_short_and_optimal():
    r = np.random.default_rng(3)
    counts = np.concatenate([r.integers(1, 50, 300), 2 ** np.arange(40)])
    lengths = token_output.huffman_lengths(counts)
    assert lengths.max() <= token_output.MAX_BITS and np.isclose(np.sum(0.5 ** lengths.astype(float)), 1.0)


def test_sites_move_verdicts(spark, labels):
    """Neutral texts on a site of bad ones are judged worse than on a site of good ones."""
    docs = queries.documents(spark, SF)
    table = quality_classifier.classify(docs, labels).join(docs.select("doc_id", "text"), "doc_id").orderBy("doc_score").collect()
    low, high, middle = table[0].text, table[-1].text, table[len(table) // 20].text
    rows = [(k, low if k < 40 else high, "en", "bad" if k < 40 else "good") for k in range(80)] + [(100, middle, "en", "bad"), (101, middle, "en", "good"), (102, middle, "en", "alone")]
    few = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    source = docs.select("doc_id", "text", "lang", "source").withColumn("doc_id", F.col("doc_id") + 1_000)
    both = few.unionByName(source)
    got = {r.doc_id: r for r in quality_classifier.classify(both, labels.withColumn("doc_id", F.col("doc_id") + 1_000)).where("doc_id in (100, 101, 102)").collect()}
    assert got[100].posterior < got[102].posterior < got[101].posterior
    assert got[100].host_posterior < got[102].host_posterior < got[101].host_posterior


def test_stages_on_odd_rows(spark, odd):
    stages = dict(corpus_pipeline.STAGES)
    last = stages["packing"](spark, odd, SF).collect()
    assert len({(r.doc_id, r.start) for r in last}) >= 7 and stages["packing"](spark, odd.limit(0), SF).count() == 0
    for name, stage in list(stages.items())[:4]:
        got = stage(spark, odd, SF)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert got.count() <= len(ODD) and stage(spark, odd.limit(0), SF).count() == 0
    assert stages["suffix-array dedup"](spark, odd, SF).count() == len(ODD)
    near = stages["minhash near-dedup"](spark, odd, SF).collect()
    assert sorted(len(r.text or "") for r in near) == sorted({len(r[1] or "") for r in ODD})


def test_near_copies_and_passages_go(spark):
    stages = dict(corpus_pipeline.STAGES)
    r = np.random.default_rng(4)
    word = lambda: "".join(r.choice(list("abcdefghij"), 6))
    passage = " ".join(word() for _ in range(52))
    base = [word() for _ in range(200)]
    copies = [" ".join(base[:k] + [word()] + base[k + 1 :]) for k in range(0, 200, 20)]
    clean = [" ".join(word() for _ in range(150)) for _ in range(5)]
    sharing = [f"{' '.join(word() for _ in range(60))} {passage} {' '.join(word() for _ in range(60))}" for _ in range(3)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate([*copies, *clean, *sharing])], SCHEMA.split(", words")[0])
    near = stages["minhash near-dedup"](spark, docs, SF)
    assert sorted(x.doc_id for x in near.collect()) == [0, *range(10, 18)]
    left = {x.doc_id: x for x in stages["suffix-array dedup"](spark, near, SF).collect()}
    assert all(left[10 + k].text == clean[k] for k in range(5))
    assert all(passage not in left[15 + k].text and left[15 + k].n_chars == len(left[15 + k].text) < len(sharing[k]) for k in range(3))


def test_token_output_keeps_null_and_large_ids(spark):
    rows = [(None, "one two"), (None, "three"), (2**53 + 1, "four"), (2**53, None), (-3, "five six"), (-3, "five six"), (2**62 + 1, "")]
    t = Tokenizer.from_file(BYTES)
    got = token_output.token_output(spark.createDataFrame(rows, "doc_id long, text string"), BYTES, 0).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    want = sorted((str(i), len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x in rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])


VECTORS = "vec_id long, embedding array<double>, label int"


def test_embeddings_of_null_and_shared_ids(spark):
    """Numbers of links and classes of rows that have no id, or one id with different vectors."""
    e = np.eye(6)
    near = lambda k: (e[k] + 0.1 * e[(k + 1) % 6]).tolist()
    rows = [(5, e[0].tolist(), 1), (5, e[2].tolist(), 1), (6, near(0), 1), (7, near(2), 1), (None, e[4].tolist(), 1), (None, near(4), 1), (None, (-e[0]).tolist(), 1), (8, None, 1), (9, [0.0] * 6, 1), (None, e[0].tolist(), None)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("rep", F.lit(1)).withColumn("cell", F.lit("x")).withColumn("h", F.lit(2.0))
    got = embedding_dedup.near_duplicates(df).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == sorted([
        ("5", 1, "5", True), ("5", 1, "5", True), ("6", 1, "5", False), ("7", 1, "5", False), ("None", 1, "None", True), ("None", 1, "None", True),
        ("None", 0, "None", True), ("8", 0, "8", True), ("9", 0, "9", True), ("None", 0, "None", True)])
    mixed = embedding_dedup.near_duplicates(spark.createDataFrame([(None, e[0].tolist(), 1), (3, e[0].tolist(), 1), (3, e[0].tolist(), 1)], VECTORS)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in mixed) == [("3", 2, 3, True), ("3", 2, 3, True), ("None", 2, 3, False)]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_trees_of_the_table_are_walked(spark):
    """Trees of the given vectors have several levels, most pairs of nodes are dropped, and what is left is exact."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("label = 1").collect()
    x = embedding_dedup.unit([np.array(r.embedding, float) for r in rows])
    tree, seen = embedding_dedup.CoverTree(x), {}
    found = {tuple(sorted((int(tree.order[a]), int(tree.order[b])))) for i, j in embedding_dedup.close_pairs(tree, tree, float(np.sqrt(2 - 2 * 0.93)), 0.93, seen) for a, b in zip(i, j)}
    p, q = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
    assert found == set(zip(p.tolist(), q.tolist())) and tree.depth() > 1 and seen["dropped"] > seen["met"] / 2
    stored = embedding_dedup.CoverTree.stored(tree.x, *(getattr(tree, c) for c in embedding_dedup.TREE))
    assert all((a == b).all() for a, b in zip(stored.below, tree.below))
