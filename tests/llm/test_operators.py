import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from fieldloom.llm import bpe, embedding_dedup, lm, minhash, queries, sharding, suffix_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in queries.documents(spark, SF).collect()}


def test_sharding_keeps_copies_together(spark, texts):
    rows = queries.op1_sharding(spark, SF).toPandas()
    assert len(rows) == len(texts) and rows.groupby("text_crc32").shard.nunique().max() == 1
    for _, part in rows.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_bpe_equals_library(spark, texts):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in queries.op5_bpe(spark, SF).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    own = bpe.ForcedBoundaryBPE(P.path("word_bpe_49k.json"))
    for s in ("Été 中文 don't <|endoftext|>x", "aaaa" * 3000, "", "́ ńx"):
        assert list(map(int, own.encode([s])[0][0].split())) == t.encode(s, add_special_tokens=False).ids


def test_suffix_dedup_equals_brute_force(spark, texts):
    data = {i: t.encode() for i, t in texts.items()}
    seen = collections.Counter(b[k : k + 400] for b in data.values() for k in range(len(b) - 399))
    for r in queries.op4_suffix_dedup(spark, SF).collect():
        b, gone = data[r.doc_id], np.zeros(len(data[r.doc_id]), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        assert r.n_removed == gone.sum()
        assert r.kept_sha256 == hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8))
    x = np.concatenate([x, x[:60] + 0.05 * rng.normal(size=(60, 8)), np.repeat(x[:1], 90, 0)])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 8, 1), (902, [1.0] * 8, None)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas().set_index("vec_id").sort_index()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.93) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    np.fill_diagonal(near, False)
    assert (got.n_links.values[: len(x)] == near.sum(1)).all() and (got.n_links.values[len(x) :] == 0).all()


def test_lm_base_scores(spark, texts):
    word = re.compile("[^\\x20\\x09-\\x0D]+")
    tokens = {i: word.findall(t.encode().lower().decode()) + ["\n"] for i, t in texts.items()}
    count = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n = sum(count.values())
    for r in queries.op9_lm(spark, SF).collect():
        want = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (len(count) + 1))) for w in tokens[r.doc_id])
        assert (r.n_tokens, r.train_tokens) == (len(tokens[r.doc_id]), n)
        assert r.n_known == sum(count[w] > 0 for w in tokens[r.doc_id])
        assert r.base_score == pytest.approx(want, rel=1e-9)


def test_elias_fano_round_trip():
    r = np.random.default_rng(1)
    for n, top in ((500, 1 << 63), (5000, 6000), (1, 0), (0, 0), (3000, 1 << 20)):
        v = np.sort(r.integers(0, top, n, np.uint64, True))
        e = lm.EliasFano.of(v)
        assert (e.values() == v).all()
        for a, b in ((0, n // 2), (n // 3, n), (n // 2, n // 2 + 1 if n else 0)):
            assert (e.slice(a, min(b, n)) == v[a : min(b, n)]).all()


def _trigram_scores(texts, discount=lm.DISCOUNT):
    """(score) of each (id, text) by dictionaries of counts."""
    import math
    from collections import Counter

    docs = [(i, re.findall("[^\\x20\\x09-\\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) + [None]) for i, t in texts]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for i, w in docs:
        if not lm.held_out(i):
            for u, v, x in zip([None, None, *w], [None, *w], w):
                c1[x] += 1
                c2[v, x] += 1
                c3[u, v, x] += 1
    n, kinds = sum(c1.values()), len(c1)
    cv, nv, cuv, nuv = Counter(), Counter(), Counter(), Counter()
    for (v, _), c in c2.items():
        cv[v] += c
        nv[v] += 1
    for (u, v, _), c in c3.items():
        cuv[u, v] += c
        nuv[u, v] += 1
    out = []
    for _, w in docs:
        total = 0.0
        for u, v, x in zip([None, None, *w], [None, *w], w):
            p = (c1[x] + 0.5) / (n + 0.5 * (kinds + 1))
            if cv[v]:
                p = max(c2[v, x] - discount, 0) / cv[v] + discount * nv[v] / cv[v] * p
            if cuv[u, v]:
                p = max(c3[u, v, x] - discount, 0) / cuv[u, v] + discount * nuv[u, v] / cuv[u, v] * p
            total += math.log10(p)
        out.append((len(w), sum(c1[x] > 0 for x in w), n, sum(math.log10((c1[x] + 0.5) / (n + 0.5 * (kinds + 1))) for x in w), total))
    return out


@pytest.mark.parametrize("hot", [lm.HOT, 300])
def test_lm_against_dictionaries(spark, texts, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT", hot)
    monkeypatch.setattr(lm, "SHARD", 20_000)
    monkeypatch.setattr(lm, "BATCH", 60_000)
    rows = [*texts.items(), (None, "The tHE the end"), (None, None), (3, "again the\x0bsame id"), (3, "É ß " + "long" * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.score) for r in lm.score(docs).collect())
    want = sorted((i or -1, n, k, total, round(base, 6), s) for (i, _), (n, k, total, base, s) in zip(rows, _trigram_scores(rows)))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) <= 3 * lm.UNIT / 2 * w[1] + 1e-6 for g, w in zip(got, want))
    assert lm.score(docs.where("doc_id is null")).count() == 2


def test_trie_from_a_mapped_file(tmp_path):
    words = np.array([5, 9, 12, 40], np.uint64)
    v, u, w = (np.array(x) for x in ([0, 0, 1], [1, 2, 0], [2, 3, 2]))
    pairs = np.array([0, 0, 1]), np.array([2, 3, 2]), np.array([2, 1, 4])
    p1 = lm.quantised(np.log10(np.array([0.1, 0.2, 0.3, 0.4])))
    (tmp_path / "trie").write_bytes(lm.NgramTrie.build(words, v, u, w, np.array([2, 1, 4]), pairs, p1))
    trie = lm.NgramTrie.open(str(tmp_path / "trie"))
    assert (trie.words.values() == words).all()
    got = 10 ** (-lm.UNIT * trie.log_units(np.array([0, 0, 1, 3]), np.array([1, 1, 3, 0]), np.array([2, 0, 2, 1]), p1))
    p2 = 1.5 / 3 + 1 / 3 * 0.3
    assert np.allclose(got, [1.5 / 2 + 0.25 * p2, 0.25 * (1 / 3) * 0.1, 3.5 / 4 + 0.5 / 4 * 0.3, 0.2], rtol=0.004)


def test_minhash_estimates_similarity():
    a, b = np.arange(1, 101, dtype=np.uint64), np.arange(11, 111, dtype=np.uint64)
    x, y = minhash.dart_minhash([(e, np.ones(100)) for e in (a, b)], 1024)
    assert abs((x == y).mean() - 90 / 110) < 0.06


def test_empty_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert sharding.shard(empty).count() == 0
    assert suffix_dedup.dedup(empty).count() == 0
    assert minhash.near_duplicates(empty).count() == 0
    assert lm.score(empty).count() == 0


def _classes_by_brute_force(texts, threshold=0.8):
    bags, parent = {}, {i: i for i in texts}
    for i, t in texts.items():
        bags.setdefault(t or "", []).append(i)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def link(i, j):
        i, j = root(i), root(j)
        parent[max(i, j)] = min(i, j)

    sets = []
    for t, ids in bags.items():
        for i in ids[1:]:
            link(ids[0], i)
        sets.append((ids[0], dict(zip(*minhash.shingles(t)))))
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            low = sum(min(n, b[e]) for e, n in a.items() if e in b)
            if low >= threshold * (sum(a.values()) + sum(b.values()) - low):
                link(i, j)
    return {i: root(i) for i in texts}


def test_minhash_classes_against_brute_force(spark, texts):
    base = [f"w{k}" for k in range(200)]
    chain = [" ".join(base[:k] + [f"x{j}" for j in range(k)] + base[k:]) for k in (0, 14, 28, 42)]  # neighbours alike only
    unlike = [" ".join(base[:120] + [f"u{n}_{k}" for k in range(80)]) for n in range(30)]  # share a bucket at times
    near = [" ".join(base[:n] + [f"n{n}"] + base[n + 1 :]) for n in range(60, 100)]
    made = dict(enumerate([*chain, *unlike, *near, *near[:5], None, "", "a b", "a b"], 1_000_000))
    docs = spark.createDataFrame(list((dict(texts) | made).items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == _classes_by_brute_force(dict(texts) | made)
