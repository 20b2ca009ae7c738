"""Quality classifier: hierarchical empirical Bayes over document evidence, host and path.

1. Two logistic models (quality, toxic) over hashed words and character shares are fitted on a bounded sample of
   labelled rows (``max_labelled``, the rows with the least hash of their id), and score every whole text. Toxicity also
   looks at word beginnings, so that unseen forms of a known word count.
2. For both scores, the mean of each host is shrunk toward the global mean, and that of each path (host and language)
   toward its host, with strengths estimated from the variance between hosts, and between the paths of a host; sums
   are grouped aggregates, so that a hot host is pre-aggregated before its shuffle. A document's own score is
   left out of its site's sums.
3. A document's posterior adds to its own log odds ``site_weight`` times the log odds by which its path differs
   from the global prior. It is kept if quality is at least, and toxicity below, ``threshold``.

Defined results: a null text counts as empty; a null source or language is a site of its own; without labelled rows
of both kinds the evidence is neutral and all rows are kept; repeated rows get equal scores; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

WORDS = 1 << 18
LEAST_ROWS = 4
#: Letters of the word beginnings that toxicity looks at.
BEGINNINGS = (4, 5, 6)
WORD = re.compile(r"\w+")
SHARES = ("upper", "digit", "space", "mark", "bar", "repeat", "short")


def features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indices of hashed words, then of dense shares; their values; indices of hashed word beginnings)."""
    words = text.lower().split()
    distinct = set(WORD.findall(text.lower()))
    seen = {zlib.crc32(w.encode()) % WORDS for w in distinct}
    begins = {zlib.crc32(b"^" + w[:k].encode()) % WORDS for w in distinct for k in BEGINNINGS if len(w) > k} - seen
    n, m = max(1, len(text)), max(1, len(words))
    letters = sum(map(str.isupper, text))
    marks = sum(text.count(c) for c in "#*$%&<>!@")
    dense = [letters / n, sum(map(text.count, "0123456789")) / n, text.count(" ") / n, marks / n, text.count("|") / m, 1 - len(set(words)) / m, float(len(words) < 12)]
    idx = np.fromiter(seen, np.int64, len(seen))
    return np.concatenate([idx, WORDS + np.arange(len(SHARES) + 1)]), np.concatenate([np.ones(len(idx)), 4 * np.array(dense), [1.0]]), np.fromiter(begins, np.int64, len(begins))


def scaled(idx: np.ndarray, val: np.ndarray) -> np.ndarray:
    """Values with words divided by the root of their number: style counts, and not length."""
    return np.where(idx < WORDS, val / np.sqrt(max(1, len(idx) - len(SHARES) - 1)), val)


def fit_logistic(at: np.ndarray, idx: np.ndarray, val: np.ndarray, y: np.ndarray, by_ratio: bool, steps: int = 150) -> np.ndarray:
    """Weights by accelerated full gradients with a step for each coordinate. ``at``, ``idx``, ``val``: row, feature, value.

    ``by_ratio``: a word counts only if LEAST_ROWS labelled rows hold it, by its log count ratio between both kinds."""
    size = WORDS + len(SHARES) + 1
    w = np.zeros(size)
    if len(y) == 0 or y.min() == y.max():
        return w
    rate, l2, ratio = 0.1, 1e-5, np.ones(size)
    if by_ratio:
        rate, l2 = 0.03, 1e-4
        yes, all_rows = np.bincount(idx[(y > 0)[at]], minlength=size), np.bincount(idx, minlength=size)
        ratio = np.log((yes + 1) / (y.sum() + 2)) - np.log((all_rows - yes + 1) / (len(y) - y.sum() + 2))
        ratio[all_rows < LEAST_ROWS] = 0.0
        ratio[WORDS:] = 1.0
        some = (ratio != 0)[idx]
        at, idx, val = at[some], idx[some], val[some]
        val = val * ratio[idx]
    m, s = np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, val * w[idx], len(y)), -30, 30)))
        g = np.bincount(idx, val * (p - y)[at], size) / len(y) + l2 * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return w * ratio


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 8_000) -> np.ndarray:
    """(2, features): quality and toxic weights."""
    few = labels.where("quality is not null and toxic is not null").dropDuplicates(["doc_id"]).select("doc_id", "quality", "toxic")
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # the bounded sample
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")

    def run(batches):
        for batch in batches:
            f = [features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([x[k].astype(t).tobytes() for x in f], pa.binary()) for k, t in enumerate(("<i4", "<f4", "<i4"))), batch.column(1), batch.column(2)], names=["i", "v", "b", "quality", "toxic"])

    rows = got.select("text", F.col("quality").cast("int"), F.col("toxic").cast("int")).mapInArrow(run, "i binary, v binary, b binary, quality int, toxic int").collect()
    quality, toxic = (np.array([float(r[k]) for r in rows]) for k in ("quality", "toxic"))
    # rows, features and values flat, in 32 bits: the driver holds the sample several times over
    at, idx, val, styled = [], [], [], []
    extra_at, extra = [], []
    for k, r in enumerate(rows):
        i, v, begins = np.frombuffer(r.i, "<i4"), np.frombuffer(r.v, "<f4"), np.frombuffer(r.b, "<i4")
        at.append(np.full(len(i), k, np.int32))
        idx.append(i)
        val.append(v.astype(np.float32))
        styled.append(scaled(i, v).astype(np.float32))
        extra_at.append(np.full(len(begins), k, np.int32))
        extra.append(begins)
    del rows
    join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    weights = [fit_logistic(join(at, np.int32), join(idx, np.int32), join(styled, np.float32), quality, False)]
    del styled
    ones = [np.ones(sum(map(len, extra)), np.float32)]
    weights.append(fit_logistic(join(at + extra_at, np.int32), join(idx + extra, np.int32), join(val + ones, np.float32), toxic, True))
    return np.array(weights)


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = 8_000, site_weight: float = 0.5, threshold: float = 0.5, id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, doc_score, toxic_score, host_posterior, path_posterior, posterior, toxic_posterior, kept, carry..) of every row."""
    scratch = Scratch(docs.sparkSession, "quality_classifier")
    weights = train(docs, labels, max_labelled)

    def run(batches):
        for batch in batches:
            out = np.empty((batch.num_rows, 2))
            for k, text in enumerate(batch.column(3).to_pylist()):
                i, v, begins = features(text)
                out[k] = weights[0, i] @ scaled(i, v), weights[1, i] @ v + weights[1, begins].sum()
            p = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(p[:, 0]), pa.array(p[:, 1]), *batch.columns[4:]], names=["doc_id", "host", "path", "doc_score", "toxic_score", *(f"c_{c}" for c in carry)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("host"), F.coalesce("lang", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"), *(F.col(c).alias(f"c_{c}") for c in carry))
    schema = "".join(f", `c_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    scored = scratch.table(rows.mapInArrow(run, "doc_id long, host string, path string, doc_score double, toxic_score double" + schema), "scored")
    kinds = ("doc", "toxic")
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), *(F.sum(f"{k}_score").alias(f"s_{k}") for k in kinds))
    paths = scratch.table(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), *(F.sum(f"s_{k}").alias(f"h_{k}") for k in kinds))
    sites = scratch.table(paths.join(hosts, "host"), "sites")
    found = hosts.agg(F.sum("hn").alias("n"), F.avg(1 / F.col("hn")).alias("inv"), *(f for k in kinds for f in (F.sum(f"h_{k}").alias(k), F.var_samp(F.col(f"h_{k}") / F.col("hn")).alias(f"v_{k}")))).first()
    apart = lambda k: F.col(f"s_{k}") / F.col("n") - F.col(f"h_{k}") / F.col("hn")
    below = sites.agg(F.avg(1 / F.col("n")).alias("inv"), *(F.avg(apart(k) * apart(k)).alias(k) for k in kinds)).first()
    out = scored.join(sites, ["host", "path"])
    odds = lambda p: F.log(p / (1 - p))
    for k in kinds:
        prior = min(max((found[k] or 0.0) / (found.n or 1), 1e-4), 1 - 1e-4)
        within = prior * (1 - prior)
        # strengths of the Beta priors, by moments: within a site by the variance left between sites
        by_host, by_path = (max(within / max((v or 0.0) - within * (inv or 0.0), within / 10_000) - 1, 1.0) for v, inv in ((found[f"v_{k}"], found.inv), (below[k], below.inv)))
        own = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col(f"{k}_score")))
        host = (F.col(f"h_{k}") - F.col(f"{k}_score") + by_host * prior) / (F.col("hn") - 1 + by_host)
        path = (F.col(f"s_{k}") - F.col(f"{k}_score") + by_path * F.col(f"{k}_host")) / (F.col("n") - 1 + by_path)
        # a difference of sums may leave [0, 1] by rounding
        within_bounds = lambda p: F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
        out = out.withColumn(f"{k}_host", within_bounds(host)).withColumn(f"{k}_path", within_bounds(path))
        post = odds(own) + site_weight * (odds(F.col(f"{k}_path")) - odds(F.lit(prior)))
        out = out.withColumn(f"{k}_posterior", 1 / (1 + F.exp(-post)))
    kept = (F.col("doc_posterior") >= threshold) & (F.col("toxic_posterior") < threshold)
    if not weights[0].any():
        kept = F.lit(True) if not weights[1].any() else F.col("toxic_posterior") < threshold
    names = [F.col("doc_host").alias("host_posterior"), F.col("doc_path").alias("path_posterior"), F.col("doc_posterior").alias("posterior"), "toxic_posterior"]
    return out.select("doc_id", "doc_score", "toxic_score", *names, kept.alias("kept"), *(F.col(f"c_{c}").alias(c) for c in carry))
