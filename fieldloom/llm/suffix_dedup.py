"""Suffix-array dedup: bytes under a string of ``length`` bytes that also starts anywhere else are removed.

1. In each text every window of ``length`` bytes has an anchor, the leftmost gram of least hash in it; a gram has the
   greatest power of two of bytes up to a third of the length. Equal windows have equal anchors at equal places.
   Neighbouring windows of one anchor are a run; a run is known by its gram and by the digest of the bytes it spans.
   Runs whose gram no other run has are done with.
2. Runs that occur twice, by that digest, are repeated whole, and so is a text that occurs twice. Of a gram with several
   different runs, one sample of each run is fetched and cut by window offset; per piece of offsets its suffixes are
   sorted: multikey quicksort over 8-byte words down to a shallow depth, then blind tries for the groups that still
   agree. Windows that end in one leaf are repeated.
3. The intervals found go back to all runs, and each text is cut once.

Texts are known by their 256-bit hash, so that ids play no part in what is searched; of copies that one task reads, one is
searched.

Defined results: a null text is empty and keeps nothing; repeated rows are copies of each other; rows with a null id
or with an id that other texts have too are treated as all others, and every row comes back; texts below the length
are kept whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64

PIECE = 64
SHALLOW = 64
#: Runs that one sorting task handles on average.
BUCKET_RUNS = 2048
BASE = 0x9E3779B97F4A7C15


def gram_size(length: int) -> int:
    return 1 << max(0, (length // 3).bit_length() - 1)


def gram_hashes(data: bytes, width: int) -> np.ndarray:
    """Hashes of all grams, by doubling: h(2w) from two h(w)."""
    h, w = mix64(np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(BASE)), 1
    while w < width:
        h = mix64(h[:-w] * np.uint64(3) + h[w:]) if len(h) > w else h[:0]
        w *= 2
    return h


def runs(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor place, first window, last window, gram hash) of each run."""
    gram = gram_size(length)
    h = gram_hashes(data, gram)
    width = length - gram + 1
    n = len(h) - width + 1
    pad = -len(h) % width
    grid = np.append(h, np.full(pad, np.iinfo(np.uint64).max)).reshape(-1, width)
    head = np.minimum.accumulate(grid, 1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    low = np.minimum(tail[:n], head[width - 1 : width - 1 + n])
    values, lows = np.unique(low, return_inverse=True)
    at = np.searchsorted(values, h)
    at[at == len(values)] = 0
    place = np.flatnonzero(values[at] == h)
    key = np.sort(at[place].astype(np.int64) * (len(h) + 1) + place)
    anchor = key[np.searchsorted(key, lows.astype(np.int64) * (len(h) + 1) + np.arange(n))] % (len(h) + 1)
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    last = np.append(first[1:], n) - 1
    return anchor[first], first, last, low[first]


def blind_trie(strings: list[bytes]) -> list[list[int]]:
    """Leaves (indices of equal strings) in lexicographic order; all strings have one length."""
    root = [None, [0]]
    for k in range(1, len(strings)):
        s, node = strings[k], root
        while node[0] is not None:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = strings[node[1][0]]
        if other == s:
            node[1].append(k)
            continue
        differ = np.frombuffer(other, np.uint8) != np.frombuffer(s, np.uint8)
        depth, node = int(differ.argmax()), root
        while node[0] is not None and node[0] < depth:
            node = node[1][s[node[0]]]
        if node[0] == depth:
            node[1][s[depth]] = [None, [k]]
        else:
            below = [node[0], node[1]]
            node[0], node[1] = depth, {other[depth]: below, s[depth]: [None, [k]]}
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] is None:
            out.append(node[1])
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def multikey_quicksort(data: bytes, starts: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, group) of all ``starts`` whose first ``depth`` bytes agree with another's of the same ``group``.

    Groups are in lexicographic order inside each of the groups given. All groups are parted side by side: each round
    parts a group in three by one 8-byte word, less than, equal to and greater than its middle member's; the equal part
    goes on with the next word. A start alone in its part is done with.
    """
    raw = data + bytes(8)
    flat = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))
    index = np.argsort(group, kind="stable")
    fresh = np.append(True, np.diff(group[index]) != 0)[: len(index)]
    number, at = np.cumsum(fresh) - 1, np.zeros(len(index), np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    rank = np.arange(len(index), dtype=np.int64)  # where a part begins among all, which orders the parts
    rank = rank[np.flatnonzero(fresh)][number] if len(index) else rank
    while True:
        size = np.bincount(number)[number] if len(number) else number
        ripe = (size > 1) & (at >= depth)
        if ripe.any():
            done.append((index[ripe], rank[ripe]))
        live = (size > 1) & ~ripe
        index, at, rank, number = index[live], at[live], rank[live], number[live]
        if not len(index):
            break
        begin = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        count = np.diff(np.append(begin, len(number)))
        word = flat[starts[index] + at].astype(np.uint64)
        pivot = np.repeat(word[begin + count // 2], count)
        side = (word >= pivot).astype(np.int64) + (word > pivot)
        part = np.repeat(np.arange(len(begin)), count) * 3 + side
        order = np.argsort(part, kind="stable")
        index, at, rank, part = index[order], at[order] + 8 * (side[order] == 1), rank[order], part[order]
        fresh = np.append(True, part[1:] != part[:-1])
        number = np.cumsum(fresh) - 1
        begin = np.flatnonzero(fresh)
        inside = np.flatnonzero(np.append(True, part[1:] // 3 != part[:-1] // 3))
        origin = np.repeat(inside, np.diff(np.append(inside, len(part))))
        rank = rank + begin[number] - origin
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index, rank = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(rank, kind="stable")
    return index[order], rank[order]


def equal_groups(data: bytes, starts: np.ndarray, length: int, group: np.ndarray) -> list[np.ndarray]:
    """Groups of two or more ``starts`` of one ``group`` whose ``length`` bytes are equal, in suffix order."""
    index, part = multikey_quicksort(data, starts, group, min(SHALLOW, length // 8 * 8))
    out = []
    for members in np.split(index, np.flatnonzero(np.diff(part)) + 1) if len(index) else []:
        for leaf in blind_trie([data[s : s + length] for s in starts[members].tolist()]):
            if len(leaf) > 1:
                out.append(members[leaf])
    return out


def removed_spans(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, data, spans, carry..): every row's bytes and the spans removed as start, end; ``carry``: columns passed on."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix_dedup")
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), data.alias("data"), *(F.col(c).alias(f"c_{c}") for c in carry))
    keyed = plain.withColumn("h", F.unhex(F.sha2("data", 256)))
    copied = keyed.where(F.octet_length("data") >= length).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", F.lit(True).alias("copied"))
    names = ["h", "p", "s0", "s1", "gram", "span"]

    def find(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                h = hashlib.sha256(raw).digest()
                if h in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(h)
                p, s0, s1, g = runs(raw, length)
                spans = [hashlib.blake2b(raw[a : b + length], digest_size=16).digest() for a, b in zip(s0.tolist(), s1.tolist())]
                cols = [pa.array([h] * len(p), pa.binary()), pa.array(p), pa.array(s0), pa.array(s1), pa.array(g.astype(np.int64)), pa.array(spans, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    long_texts = plain.where(F.octet_length("data") >= length).select("data")
    found = scratch.table(long_texts.mapInArrow(find, "h binary, p long, s0 long, s1 long, gram long, span binary"), "runs")
    again = found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    repeated = scratch.table(found.join(again, "gram"), "repeated")
    scratch.drop(found)
    # a run's windows by offset l = p - s; runs of one content have one range of offsets
    kinds = repeated.groupBy("gram", "span", (F.col("p") - F.col("s1")).alias("l0"), (F.col("p") - F.col("s0")).alias("l1")).agg(F.count("*").alias("n"), F.min(F.struct("h", "p")).alias("at"))
    kinds = scratch.table(kinds, "kinds")
    several = kinds.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram")
    sample = kinds.join(several, "gram", "left_semi").select(F.col("at.h").alias("h"), F.col("at.p").alias("p"), "gram", "span", "l0", "l1")
    sample = scratch.table(sample, "samples")
    wanted = sample.groupBy("h").agg(F.collect_list(F.struct("p", "gram", "span", "l0", "l1")).alias("runs"))
    piece_names = ["gram", "piece", "span", "l0", "l1", "data"]

    def cut(batches):
        for batch in batches:
            rows = []
            for raw, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for r in want:
                    for piece in range(r["l0"] // PIECE, r["l1"] // PIECE + 1):
                        a, b = max(r["l0"], piece * PIECE), min(r["l1"], piece * PIECE + PIECE - 1)
                        rows.append((r["gram"], piece, r["span"], a, b, raw[r["p"] - b : r["p"] - a + length]))
            for at in range(0, len(rows), 4096):
                cols = list(zip(*rows[at : at + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))], names=piece_names)

    pieces = keyed.where(F.octet_length("data") >= length).join(wanted, "h").dropDuplicates(["h"]).select("data", "runs").mapInArrow(cut, "gram long, piece int, span binary, l0 long, l1 long, data binary")

    def sort(table: pa.Table) -> pa.Table:
        raw = table.column("data").to_pylist()
        l0, l1 = table.column("l0").to_numpy(), table.column("l1").to_numpy()
        base = np.cumsum([0] + [len(r) for r in raw])
        whole = b"".join(raw)
        many = l1 - l0 + 1
        row = np.repeat(np.arange(len(raw)), many)
        off = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + l0[row]
        gram = np.unique(table.column("gram").to_numpy(), return_inverse=True)[1]
        leaves = equal_groups(whole, base[row] + l1[row] - off, length, gram[row] * length + off)
        picked = np.concatenate(leaves) if leaves else np.zeros(0, np.int64)
        rows, ls = row[picked], off[picked]
        order = np.lexsort((ls, rows))
        rows, ls = rows[order], ls[order]
        first = np.flatnonzero(np.append(True, (np.diff(rows) != 0) | (np.diff(ls) != 1))) if len(rows) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(rows))[: len(first)] - 1
        part = table.take(pa.array(rows[first], pa.int64()))
        return pa.table({"gram": part.column("gram"), "span": part.column("span"), "l0": pa.array(ls[first], pa.int64()), "l1": pa.array(ls[last], pa.int64())})

    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sample.count() // BUCKET_RUNS + 1)
    partly = pieces.groupBy(F.pmod(F.xxhash64("gram", "piece"), F.lit(buckets)).alias("bucket")).applyInArrow(sort, "gram long, span binary, l0 long, l1 long")
    alike = kinds.where("n > 1").select("gram", "span", "l0", "l1")
    hits = scratch.table(alike.union(partly).groupBy("gram", "span").agg(F.collect_list(F.struct("l0", "l1")).alias("ls")), "hits")
    spots = repeated.join(hits, ["gram", "span"]).select("h", "p", F.explode("ls").alias("l"))
    spots = spots.select("h", (F.col("p") - F.col("l.l1")).alias("a"), (F.col("p") - F.col("l.l0") + length).alias("b")).distinct()
    per_text = spots.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    marks = scratch.table(per_text.join(copied, "h", "full"), "marks")
    scratch.keep(marks)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.octet_length("data").cast("long").alias("b")))
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    return keyed.join(marks, "h", "left").select("doc_id", "data", F.when(F.coalesce("copied", F.lit(False)), whole).otherwise(F.coalesce("spans", none)).alias("spans"), *(f"c_{c}" for c in carry))


def _merged(spans: list[dict]) -> list[list[int]]:
    out: list[list[int]] = []
    for s in spans:
        if out and s["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["b"])
        else:
            out.append([s["a"], s["b"]])
    return out


def dedup(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, carry..): ``kept`` is what is left, with bytes that no longer
    form a character dropped from the text's form."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, raw, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
                gone, at, kept = _merged(spans), 0, []
                for a, b in gone:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                rows.append((doc, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds)), *batch.columns[3:]], names=[*names, *carry])

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return removed_spans(docs, length, id_col, text_col, carry).mapInArrow(run, schema)
