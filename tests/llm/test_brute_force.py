"""The classifier's query and the five stages of the pipeline, each against loops over its whole input."""

import collections
import math
import statistics
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_operators import _classes_by_brute_force
from tokenizers import Tokenizer

from fieldloom.llm import oracles, quality_classifier, queries

SF = "/root/testdata/sf0.001"


def _logistic(x):
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, x))))


def _scores(weights, text):
    """Evidence of one text, word by word."""
    at, values, begins = quality_classifier.features(text)
    words = sum(1 for i in at if i < quality_classifier.WORDS)
    style = sum(weights[0, i] * v / (math.sqrt(max(1, words)) if i < quality_classifier.WORDS else 1.0) for i, v in zip(at, values))
    bad = sum(weights[1, i] * v for i, v in zip(at, values)) + sum(weights[1, i] for i in begins)
    return _logistic(style), _logistic(bad)


def _posteriors(rows, site_weight=0.5):
    """(host, path, score) of all documents: posteriors of host, path and document, each by going over all rows of its site."""
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for h, p, s in rows:
        hosts[h].append(s)
        paths[h, p].append(s)
    prior = min(max(sum(s for _, _, s in rows) / len(rows), 1e-4), 1 - 1e-4)
    within = prior * (1 - prior)
    means = {h: statistics.fmean(v) for h, v in hosts.items()}

    def strength(spread, inverse):
        return max(within / max(spread - within * inverse, within / 10_000) - 1, 1.0)

    by_host = strength(statistics.variance(means.values()) if len(means) > 1 else 0.0, statistics.fmean(1 / len(v) for v in hosts.values()))
    by_path = strength(statistics.fmean((statistics.fmean(v) - means[h]) ** 2 for (h, _), v in paths.items()), statistics.fmean(1 / len(v) for v in paths.values()))
    odds = lambda p: math.log(p / (1 - p))
    out = []
    for h, p, s in rows:
        others = len(hosts[h]) - 1
        host = (sum(hosts[h]) - s + by_host * prior) / (others + by_host)
        path = (sum(paths[h, p]) - s + by_path * host) / (len(paths[h, p]) - 1 + by_path)
        x = odds(min(max(s, 1e-9), 1 - 1e-9)) + site_weight * (odds(path) - odds(prior))
        out.append((host, path, 1 / (1 + math.exp(-x))))
    return out


def _judged(docs, weights):
    """Of rows with text, source and lang: scores, posteriors and verdict."""
    scores = [_scores(weights, d.text or "") for d in docs]
    sites = [(d.source or "", d.lang or "") for d in docs]
    good, bad = (_posteriors([(*site, s[k]) for site, s in zip(sites, scores)]) for k in (0, 1))
    return [(s, g, b, g[2] >= 0.5 and b[2] < 0.5) for s, g, b in zip(scores, good, bad)]


@pytest.mark.parametrize("hosts", [None, 7])
def test_classifier_equals_loops(spark, hosts):
    """The query itself, and the same over sites of unequal size, one of which has a third of all rows."""
    docs, labels = queries.documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    if hosts:
        docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("h"), F.col("doc_id") % hosts)))
        got = quality_classifier.classify(docs, labels).collect()
    else:
        got = queries.op2_quality_classifier(spark, SF).collect()
    rows = docs.collect()
    want = dict(zip((d.doc_id for d in rows), _judged(rows, quality_classifier.train(docs, labels))))
    assert len(got) == len(want)
    for r in got:
        (score, toxic), good, bad, kept = want[r.doc_id]
        assert np.allclose([r.doc_score, r.toxic_score], [score, toxic], atol=1e-3)
        assert np.allclose([r.host_posterior, r.path_posterior, r.posterior, r.toxic_posterior], [*good, bad[2]], atol=5e-3)
        assert r.kept == kept or min(abs(good[2] - 0.5), abs(bad[2] - 0.5)) < 5e-3
    assert 0 < sum(r.kept for r in got) < len(got)


def _without_repeats(texts, least):
    """Texts without each byte of a string of ``least`` bytes that starts twice or more."""
    data = [t.encode() for t in texts]
    seen = collections.Counter(b[k : k + least] for b in data for k in range(len(b) - least + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - least + 1):
            if seen[b[k : k + least]] > 1:
                gone[k : k + least] = True
        out.append(bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore"))
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Each stage against loops or SQL over all that its predecessor kept, and the whole run against the last of them."""
    docs = queries.documents(spark, SF)
    stages, kept = dict(corpus_pipeline.STAGES), [docs.select(*corpus_pipeline.COLUMNS)]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(f"{tmp_path}/{n}")
        kept.append(spark.read.parquet(f"{tmp_path}/{n}"))
    given, ruled, judged, single, cut = (k.collect() for k in kept[:5])
    assert list(stages) == ["quality rules", "quality classifier", "minhash near-dedup", "suffix-array dedup", "packing"]

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    passed = {i for i, ok in con.execute(f"select doc_id, kept from ({oracles.QUALITY_RULES})").fetchall() if ok}
    assert {r.doc_id for r in ruled} == passed and 0 < len(ruled) < len(given)

    weights = quality_classifier.train(kept[1], spark.read.parquet(f"{SF}/labels.parquet"))
    want = {d.doc_id: v for d, v in zip(ruled, _judged(ruled, weights))}
    close = {i for i, (_, good, bad, _) in want.items() if min(abs(good[2] - 0.5), abs(bad[2] - 0.5)) < 5e-3}
    assert {r.doc_id for r in judged} - close == {i for i, v in want.items() if v[3]} - close and len(judged) < len(ruled)

    classes = _classes_by_brute_force({r.doc_id: r.text or "" for r in judged})
    assert sorted(classes[r.doc_id] for r in single) == sorted(set(classes.values())) and len(single) < len(judged)

    texts = _without_repeats([r.text or "" for r in single], corpus_pipeline.PASSAGE_BYTES)
    left = {r.doc_id: r for r in cut}
    assert len(left) == len(single) and any(t != r.text for t, r in zip(texts, single))
    for t, r in zip(texts, single):
        assert left[r.doc_id].text == t and left[r.doc_id].n_chars == len(t)

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in cut}
    for result in (kept[5], corpus_pipeline.run(spark, SF)):
        pieces = result.toPandas()
        # of copies another one may stay in another run; texts are what they were
        held = {zlib.crc32(v.tobytes()) for v in ids.values()}
        assert pieces.groupby("doc_id").doc_tokens.first().sum() == sum(map(len, ids.values())) == pieces.length.sum()
        for doc, part in pieces.sort_values("start").groupby("doc_id"):
            if doc in ids:
                assert (part.start.to_numpy() == np.cumsum(part.length.to_numpy()) - part.length.to_numpy()).all()
                for p in part.itertuples():
                    assert zlib.crc32(ids[doc][p.start : p.start + p.length].tobytes()) == p.ids_crc32
            elif len(part) == 1:
                assert int(part.ids_crc32.iloc[0]) in held
        for _, part in pieces.sort_values("offset").groupby("sequence_id"):
            assert (part.offset.to_numpy() == np.cumsum(part.length.to_numpy()) - part.length.to_numpy()).all() and part.length.sum() <= 2048
