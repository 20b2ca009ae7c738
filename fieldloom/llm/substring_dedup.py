"""Substring dedup by compressed FM-indexes: words under a window of ``length`` words that also starts anywhere else go.

1. Every window has an anchor, the leftmost gram of GRAM words with the least hash in it; equal windows have equal anchors
   at equal places. Neighbouring windows of one anchor are a run. Runs whose gram no other run has are done with.
2. Runs of one gram and of equal words are one kind; windows of a kind that occurs twice are repeated. The kinds of grams that have
   several are dealt over shards by gram, so that whatever a window could equal is in its shard.
3. A shard's kinds are one sequence of words. Its FM-index is the Burrows-Wheeler transform in a Huffman-shaped wavelet
   tree of packed bits with sampled ranks, so that a word takes about its entropy. The shard's runs are streamed
   against it: backward search from every window's last words, all windows side by side, gives matching statistics
   (how many words, counted back from there and at most ``length``, occur twice or more). Windows that reach ``length`` are
   reported as intervals.
4. The intervals found go back to all runs, and each text is cut once.

Grams with more than MANY kinds, such as the last words of a line that stands in many surroundings, would fill a shard: each of
their windows is dealt by its own 128-bit digest instead, and counted there, which is exact as well.

Texts are known by their hash, so ids play no part in what is searched. Of a text that occurs twice all words go, if it has a
window at all.

Defined results: a null text is empty; repeated rows are copies of each other; rows with a null id or with an id that
other texts have too are treated as all others, and every row comes back; texts of fewer words than the length are kept
whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64

GRAM = 8
#: Kinds of one gram that a shard takes, and kinds of all grams that one indexing task takes on average.
MANY, SHARD_KINDS = 128, 4096
#: Words whose intervals a search begins with, a power of two.
SEED = 16
BASE = np.uint64(0x9E3779B97F4A7C15)

#: Weights of a byte by its place in a word; windows whose anchors are sought at once.
PLACES, WINDOWS = 1024, 1 << 23
WEIGHTS = mix64(np.arange(1, PLACES + 1, dtype=np.uint64) * BASE) | np.uint64(1)


class Words:
    """A text's words joined by one space, where each begins and ends, and 64-bit hashes, which only decide what meets what."""

    def __init__(self, raw: bytes):
        self.text = b" ".join(raw.split())
        data = np.frombuffer(self.text, np.uint8)
        gaps = np.flatnonzero(data == 32)
        self.begin, self.end = np.append(0, gaps + 1), np.append(gaps, len(data))
        self.n = len(self.begin) if len(data) else 0

    def hashes(self) -> np.ndarray:
        out = []
        for at in range(0, self.n, 1 << 16):
            begin, end = self.begin[at : at + (1 << 16)], self.end[at : at + (1 << 16)]
            data = np.frombuffer(self.text, np.uint8, int(end[-1] - begin[0]), int(begin[0])).astype(np.uint64)
            place = np.arange(len(data)) - np.repeat(begin - begin[0], np.diff(np.append(begin, end[-1] + 1)))[: len(data)]
            data = (data + np.uint64(1)) * WEIGHTS[place & (PLACES - 1)]
            data[(end - begin[0])[:-1]] = 0
            out.append(np.add.reduceat(data, begin - begin[0]))
        return mix64(np.concatenate(out))

    def slice(self, first: int, past: int) -> bytes:
        return self.text[self.begin[first] : self.end[past - 1]]


def runs(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor place, first window, last window, gram hash) of each run of windows with one anchor."""
    h, w = hashes, 1
    while w < GRAM and 2 * w <= length:  # grams by doubling
        h = h[:-w] * BASE + h[w:] + np.uint64(w)
        w *= 2
    h = mix64(h)
    width = length - w + 1
    anchors = []
    for at in range(0, len(h) - width + 1, WINDOWS):
        some = h[at : at + WINDOWS + width - 1]
        # least hash, then least place, by minima over spans that double
        low = (some & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(some), dtype=np.uint64)
        span = 1
        while span < width:
            step = min(span, width - span)
            low = np.minimum(low[:-step], low[step:])
            span += step
        anchors.append((low & np.uint64(0xFFFFFF)).astype(np.int64) + at)
    anchor = np.concatenate(anchors)
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    last = np.append(first[1:], len(anchor)) - 1
    return anchor[first], first, last, h[anchor[first]]


class RankedBits:
    """Packed bits with the number of ones before every 64th."""

    def __init__(self, bits: np.ndarray):
        whole = np.zeros(-(-len(bits) // 64) * 64 + 64, np.uint8)
        whole[: len(bits)] = bits
        self.words = np.packbits(whole, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int64)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & below)


def huffman_tree(counts: np.ndarray) -> np.ndarray:
    """(inner nodes, 2): children by bit; symbols as they are, inner node k as ``len(counts) + k``, the root last."""
    heap = [(int(c), s) for s, c in enumerate(counts)]
    heapify(heap)
    nodes = []
    while len(heap) > 1:
        (a, x), (b, y) = heappop(heap), heappop(heap)
        heappush(heap, (a + b, len(counts) + len(nodes)))
        nodes.append((x, y))
    return np.array(nodes, np.int64).reshape(-1, 2)


class WaveletTree:
    """A sequence of symbols 0 .. n - 1 in a Huffman-shaped tree; ranks of many symbols at many places side by side."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        tree = huffman_tree(np.bincount(sequence, minlength=symbols))
        self.child, self.symbols = tree, symbols
        self.start = np.zeros(len(tree), np.int64)
        self.parent = np.full(symbols + len(tree), -1, np.int64)
        self.side = np.zeros(symbols + len(tree), np.int64)
        for bit in (0, 1):
            self.parent[tree[:, bit]] = np.arange(len(tree)) if len(tree) else []
            self.side[tree[:, bit]] = bit
        # the path of every symbol from the root, so that a level of all nodes is parted at once
        self.depth = np.zeros(symbols + len(tree), np.int64)
        for k in range(len(tree) - 1, -1, -1):
            self.depth[tree[k]] = self.depth[symbols + k] + 1
        deepest = int(self.depth[:symbols].max()) if symbols else 0
        self.path = np.full((symbols, deepest), -1, np.int64)  # nodes from the root down
        self.bits_of = np.zeros((symbols, deepest), np.int64)
        now = np.arange(symbols)
        while len(tree):
            up = self.parent[now]
            live = np.flatnonzero(up >= 0)
            if not len(live):
                break
            at = self.depth[now[live]] - 1
            self.path[live, at], self.bits_of[live, at] = up[live], self.side[now[live]]
            now = now.copy()
            now[live] = symbols + up[live]
        parts, filled = [], 0
        rows = sequence
        for level in range(deepest):
            rows = rows[self.path[rows, level] >= 0]
            node = self.path[rows, level]
            order = np.argsort(node, kind="stable")
            rows, node = rows[order], node[order]
            fresh = np.flatnonzero(np.append(True, node[1:] != node[:-1]))[: len(node)]
            self.start[node[fresh]] = filled + fresh
            parts.append(self.bits_of[rows, level].astype(np.uint8))
            filled += len(rows)
        self.bits = RankedBits(np.concatenate([*parts, np.zeros(0, np.uint8)]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each ``symbol`` among the first ``at``."""
        at = at.copy()
        live = np.arange(len(at))
        for level in range(self.path.shape[1]):
            live = live[self.path[symbol[live], level] >= 0]
            if not len(live):
                break
            start = self.start[self.path[symbol[live], level]]
            ones = self.bits.ones(start + at[live]) - self.bits.ones(start)
            at[live] = np.where(self.bits_of[symbol[live], level] == 1, ones, at[live] - ones)
        return at


def suffix_order(sequence: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes by their first ``depth`` symbols at least, ties by place, which is what searches of that length need; and for
    each place the interval of the suffixes that agree with its own in ``seed`` symbols, a power of two."""
    n, k = len(sequence), 1
    rank = np.unique(sequence, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    low = high = None
    while True:
        if low is None and (k >= seed or rank[order[-1]] == n - 1):
            begin = np.flatnonzero(np.append(True, np.diff(rank[order]) != 0))
            low, high = begin[rank], np.append(begin[1:], n)[rank]
        if k >= depth or rank[order[-1]] == n - 1:
            return order, low, high
        after = np.zeros(n, np.int64)
        after[:-k] = rank[k:][: n - k] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        fresh = np.append(True, np.diff(key[order]) != 0)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        k *= 2


class FMIndex:
    """Backward search over a sequence of symbols from 1; 0 parts its pieces and is part of no query. The intervals of the
    sequence's own words of SEED symbols are known, so that a search begins with them."""

    def __init__(self, sequence: np.ndarray, symbols: int, depth: int, seed: int = 0):
        self.seed = seed
        order, self.low, self.high = suffix_order(sequence, depth, max(1, seed))
        self.bwt = WaveletTree(sequence[order - 1], symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=symbols))])
        self.n = len(sequence)

    def matching(self, query: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
        """For each of ``ends``: how many symbols of ``query`` before it, at most ``length``, occur twice or more. With a seed,
        ``query`` is the sequence itself, and fewer symbols than the seed count as none."""
        got, live = np.zeros(len(ends), np.int64), np.arange(len(ends))
        if self.seed:
            low, high = self.low[ends - self.seed], self.high[ends - self.seed]
            live = np.flatnonzero(high - low > 1)
            got[live] = self.seed
        else:
            low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        low, high = low[live], high[live]
        for k in range(self.seed, length):
            symbol = query[ends[live] - 1 - k]
            both = self.bwt.rank(np.tile(symbol, 2), np.concatenate([low, high])) + np.tile(self.first[symbol], 2)
            low, high = both[: len(live)], both[len(live) :]
            on = high - low > 1
            live, low, high = live[on], low[on], high[on]
            got[live] = k + 1
        return got


def _index(length: int):
    """For applyInArrow over the kinds of one shard."""

    def run(table: pa.Table) -> pa.Table:
        words = [w.split(b" ") for w in table.column("data").to_pylist()]
        known: dict[bytes, int] = {}
        coded = [np.array([0, *(known.setdefault(w, len(known) + 1) for w in ws)], np.int64) for ws in words]
        sequence = np.concatenate([*coded, [0]])
        begin = np.cumsum([0] + [len(c) for c in coded])[:-1] + 1
        l0, l1, once = (table.column(c).to_numpy() for c in ("l0", "l1", "once"))
        index = FMIndex(sequence, len(known) + 1, length, SEED if SEED <= length else 0)
        rows = np.flatnonzero(once)
        many = (l1 - l0 + 1)[rows]
        row = np.repeat(rows, many)
        off = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + l0[row]
        # a kind's words begin with its first window, whose anchor lies l1 words on
        reached = index.matching(sequence, begin[row] + l1[row] - off + length, length) >= length
        row, off = row[reached], off[reached]
        first = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(off) != 1)))[: len(row)]
        last = np.append(first[1:], len(row))[: len(first)] - 1
        part = table.take(pa.array(row[first], pa.int64()))
        return pa.table({"gram": part.column("gram"), "span": part.column("span"), "l0": pa.array(off[first], pa.int64()), "l1": pa.array(off[last], pa.int64())})

    return run


def removed_words(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, data, spans): every row's bytes, and the words removed as first and past."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring_dedup")
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), data.alias("data"))
    keyed = plain.withColumn("h", F.unhex(F.substring(F.sha2("data", 256), 1, 32)))

    def find(batches):
        for batch in batches:
            for raw, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = Words(raw)
                if words.n < length:
                    continue
                p, s0, s1, g = runs(words.hashes(), length)
                spans = [hashlib.blake2b(words.slice(a, b + length), digest_size=16).digest() for a, b in zip(s0.tolist(), s1.tolist())]
                columns = [pa.array([h] * len(p), pa.binary()), pa.array(p.astype(np.int32)), pa.array(s0.astype(np.int32)), pa.array(s1.astype(np.int32)), pa.array(g.astype(np.int64)), pa.array(spans, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "p", "s0", "s1", "gram", "span"])

    # a word and the space after it are two bytes, so shorter texts have no window
    able = keyed.where(F.octet_length("data") >= 2 * length - 1)
    found = scratch.table(able.select("data", "h").mapInArrow(find, "h binary, p int, s0 int, s1 int, gram long, span binary"), "runs")
    # written before it is joined, so that a gram with very many runs can be split in the join
    again = scratch.table(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "again")
    repeated = scratch.table(found.join(again, "gram"), "repeated")
    scratch.drop(found)
    # a run's windows by offset l = p - s; runs of one content have one range of offsets
    kinds = repeated.groupBy("gram", "span", (F.col("p") - F.col("s1")).alias("l0"), (F.col("p") - F.col("s0")).alias("l1")).agg(F.count("*").alias("n"), F.min(F.struct("h", "p")).alias("at"))
    kinds = scratch.table(kinds, "kinds")
    several = kinds.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram", (F.col("k") > MANY).alias("many"))
    several = scratch.table(several, "several")
    sample = scratch.table(kinds.join(several, "gram").select(F.col("at.h").alias("h"), F.col("at.p").alias("p"), "gram", "span", "l0", "l1", (F.col("n") == 1).alias("once"), "many"), "samples")
    wanted = sample.groupBy("h").agg(F.collect_list(F.struct("p", "gram", "span", "l0", "l1", "once", "many")).alias("runs"))
    names = ["gram", "span", "l0", "l1", "once", "many", "data"]
    kinds_of = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())

    def cut(batches):
        """The words of each kind, or the digests of its windows."""
        for batch in batches:
            rows = []
            for raw, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = Words(raw)
                for r in want:
                    spans = [(r["l0"], r["l1"])] if not r["many"] else [(o, o) for o in range(r["l0"], r["l1"] + 1)]
                    for a, b in spans:
                        text = words.slice(r["p"] - b, r["p"] - a + length)
                        rows.append((r["gram"], r["span"], a, b, r["once"], r["many"], hashlib.blake2b(text, digest_size=16).digest() if r["many"] else text))
            for at in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 4096]), kinds_of)], names=names)

    cuts = able.join(wanted, "h").dropDuplicates(["h"]).select("data", "runs").mapInArrow(cut, "gram long, span binary, l0 long, l1 long, once boolean, many boolean, data binary")
    cuts = scratch.table(cuts, "cuts")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sample.where("not many").count() // SHARD_KINDS + 1)
    shard = F.pmod(F.xxhash64("gram"), F.lit(shards)).alias("shard")
    partly = cuts.where("not many").groupBy(shard).applyInArrow(_index(length), "gram long, span binary, l0 long, l1 long")
    windows = cuts.where("many")
    twice = windows.groupBy("data").agg(F.count("*").alias("n")).where("n > 1").select("data")
    singly = windows.where("once").join(twice, "data", "left_semi").select("gram", "span", "l0", "l1")
    alike = kinds.where("n > 1").select("gram", "span", F.col("l0").cast("long"), F.col("l1").cast("long"))
    hits = scratch.table(alike.unionByName(partly).unionByName(singly).groupBy("gram", "span").agg(F.collect_list(F.struct("l0", "l1")).alias("ls")), "hits")
    spots = repeated.join(hits, ["gram", "span"]).select("h", "p", F.explode("ls").alias("l"))
    spots = spots.select("h", (F.col("p") - F.col("l.l1")).alias("a"), (F.col("p") - F.col("l.l0") + length).alias("b")).distinct()
    per_text = spots.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    marks = scratch.table(per_text, "marks")
    scratch.keep(marks)
    return keyed.join(marks, "h", "left").select("doc_id", "data", "spans")


def _merged(spans: list[dict]) -> list[list[int]]:
    out: list[list[int]] = []
    for s in spans:
        if out and s["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["b"])
        else:
            out.append([s["a"], s["b"]])
    return out


def dedup(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): ``kept`` is the words that are left, joined by one space."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, raw, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words, at, kept = raw.split(), 0, []
                for a, b in _merged(spans or []):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                left = b" ".join(kept)
                rows.append((doc, len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()] * 2)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return removed_words(docs, length, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
