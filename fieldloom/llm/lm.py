"""LM scoring: trigram model with absolute discounting, held in Elias-Fano tries.

1. Texts become batches of tokens: each batch has its own sorted vocabulary of 64-bit word hashes, and tokens are places in
   it. Counts of training tokens go to word shards, are summed there, and come back to each batch.
2. A batch deals its trigrams (u, v, w) to shards by the middle word v, packed. A shard sums training counts and builds a
   trie of both orders that hang on v: the words that follow v, and under each word u before v the words that follow (u, v).
   Successors of (u, v) are stored as ranks among the successors of v, which are all of them that can occur; every level
   is an Elias-Fano sequence with monotone pointers, log probabilities are quantised to 16 bits. The trie is one buffer,
   read in place, from memory or from a mapped file.
3. The shard looks its batches' trigrams up: contexts in order, successors between a context's two pointers. What it gives
   back is one sum a document. A shard of many trigrams is worked off in pieces, ranges of its contexts, each with its own trie. Shards are worked off in ROUNDS rounds. A word with more than HOT training tokens is dealt over several shards by the
   word before it; its successor counts, summed over all batches first, go to each of them.

The model interpolates: p(w|u,v) = max(c - D, 0) / c(u,v) + a(u,v) p(w|v), and so on down to the base probability of a word.

Defined results: one row for each input row, also where ids are null or repeated; a null id is never held out; a null text
is the end token alone; without training tokens every token has the same base probability; an empty table gives no
rows; further columns are ignored. Words are known by 64-bit hashes, so counts are exact but for collisions.
"""

from __future__ import annotations

import hashlib
import mmap
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64
from .tokens import in_batches

DISCOUNT = 0.5
UNIT = 1 / 2048  # of a quantised log10
END = np.uint64(0x51ED270B0F0F1A2B)
#: Bytes of text in a batch; trigrams of a shard, about; training tokens of a word from which on it is dealt further.
BATCH, SHARD, HOT = 4 << 20, 800_000, 2_000_000
#: Trigrams of a shard that are worked off together.
PIECE = 400_000
#: Rounds in which the shards are worked off: only one round's trigrams are on disk at a time.
ROUNDS = 4
#: Contexts whose levels are decoded together in a lookup.
BLOCK = 2048
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class EliasFano:
    """A monotone sequence of uint64: low bits packed, high bits in unary, with a count of ones at every STEP bytes."""

    STEP = 64

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        planes = np.empty((n, low_bits), np.uint8)
        for k in range(low_bits):
            planes[:, k] = (values >> np.uint64(k)) & np.uint64(1)
        packed = np.packbits(planes.ravel())
        del planes
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        bits = np.zeros(int(high[-1]) + n + 1 if n else 0, np.uint8)
        bits[high + np.arange(n)] = 1
        raw = np.packbits(bits)
        per_byte = np.bitwise_count(np.append(raw, np.zeros(-len(raw) % cls.STEP, np.uint8))).astype(np.int64)
        ones = np.append(0, np.cumsum(per_byte.reshape(-1, cls.STEP).sum(1))).astype(np.uint64)
        return cls(n, low_bits, packed, raw, ones)

    def slice(self, a: int, b: int) -> np.ndarray:
        """Entries a to b - 1, decoded from the blocks that hold them."""
        if b <= a:
            return np.zeros(0, np.uint64)
        first = int(np.searchsorted(self.ones, a, "right")) - 1
        last = int(np.searchsorted(self.ones, b, "left"))
        bits = np.unpackbits(self.high[first * self.STEP : last * self.STEP])
        skip = a - int(self.ones[first])
        place = np.flatnonzero(bits)[skip : skip + b - a] + first * self.STEP * 8
        out = (place - np.arange(a, b)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            start, stop = a * self.low_bits, b * self.low_bits
            raw = np.unpackbits(self.low[start >> 3 : (stop + 7) >> 3])[start & 7 : (start & 7) + stop - start]
            raw = raw.reshape(-1, self.low_bits)
            low = np.zeros(len(raw), np.uint64)
            for k in range(self.low_bits):
                low |= raw[:, k].astype(np.uint64) << np.uint64(k)
            out |= low
        return out

    def values(self) -> np.ndarray:
        return self.slice(0, self.n)


class NgramTrie:
    """Levels of one shard, in one buffer: a table of sections, then each section on 8 bytes.

    ``words``: hashes of all words, ascending; a word's place is its number. ``heads``: numbers of the middle words v;
    ``next_at``, ``next``: successors of each v; ``before_at``, ``before``: words u before each v; ``last_at``, ``last``: for
    each (v, u) the ranks of w among the successors of v. Levels hold context * width + entry, so that they ascend.
    """

    LEVELS = ("words", "heads", "next_at", "next", "before_at", "before", "last_at", "last")
    TABLES = ("p2", "a2", "p3", "a3")

    def __init__(self, buffer):
        head = np.frombuffer(buffer, "<u8", 2 + 2 * (5 * len(self.LEVELS) + len(self.TABLES)))
        self.width, self.most = int(head[0]), int(head[1])
        at = iter(head[2:].tolist())

        def take(kind: str) -> np.ndarray:
            n, place = next(at), next(at)
            return np.frombuffer(buffer, kind, n, place) if n else np.zeros(0, kind)

        for name in self.LEVELS:
            n, _, low_bits, _ = next(at), next(at), next(at), next(at)
            setattr(self, name, EliasFano(n, low_bits, take("u1"), take("u1"), take("<u8")))
        for name in self.TABLES:
            setattr(self, name, take("<u2"))

    @classmethod
    def open(cls, path: str) -> NgramTrie:
        """From a file that holds the buffer, mapped into memory."""
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    @classmethod
    def build(cls, words: np.ndarray, v: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray, pairs: tuple[np.ndarray, ...], p1: np.ndarray) -> bytes:
        """Trigrams by word numbers, sorted by (v, u, w), with counts; ``pairs``: (v, w, count) sorted; ``p1``: quantised
        base log probability of each word. Returns the buffer."""
        pv, pw, pn = pairs
        size = max(1, len(words))
        heads, first = np.unique(pv, return_index=True)
        next_at = np.append(first, len(pv))
        of_pair = np.repeat(np.arange(len(heads)), np.diff(next_at))
        cv = np.add.reduceat(pn, first) if len(pv) else np.zeros(0)
        a2 = np.diff(next_at) * DISCOUNT / np.maximum(cv, 1)
        base = 10.0 ** (-p1.astype(float) * UNIT)
        p2 = np.maximum(pn - DISCOUNT, 0) / cv[of_pair] + a2[of_pair] * base[pw]
        head = np.searchsorted(heads, v)
        fresh = np.append(True, (head[1:] != head[:-1]) | (u[1:] != u[:-1]))[: len(v)]
        start = np.flatnonzero(fresh)
        last_at = np.append(start, len(v))
        of_last = np.repeat(np.arange(len(start)), np.diff(last_at))
        cuv = np.add.reduceat(n, start) if len(v) else np.zeros(0)
        a3 = np.diff(last_at) * DISCOUNT / np.maximum(cuv, 1)
        place = np.searchsorted(of_pair * size + pw, head * size + w)
        p3 = np.maximum(n - DISCOUNT, 0) / cuv[of_last] + a3[of_last] * p2[place]
        rank = place - next_at[head]
        most = int(np.diff(next_at).max()) if len(pv) else 1
        before_at = np.append(np.searchsorted(head[start], np.arange(len(heads))), len(start))
        u8 = lambda x: np.asarray(x).astype(np.uint64)
        levels = (words, u8(heads), u8(next_at), u8(of_pair * size + pw), u8(before_at), u8(head[start] * size + u[start]), u8(last_at), u8(of_last * most + rank))
        tables = [quantised(np.log10(x)) if len(x) else np.zeros(0, np.uint16) for x in (p2, a2, p3, a3)]
        sections, table = [], [size, most]
        at = 8 * (2 + 2 * (5 * len(cls.LEVELS) + len(cls.TABLES)))

        def put(x: np.ndarray) -> None:
            nonlocal at
            raw = x.tobytes()
            sections.append(raw + bytes(-len(raw) % 8))
            table.extend((len(x), at))
            at += len(sections[-1])

        for values in levels:
            e = EliasFano.of(values)
            table += [e.n, 0, e.low_bits, 0]
            for x in (e.low, e.high, e.ones.astype("<u8")):
                put(x)
        for x in tables:
            put(x.astype("<u2"))
        return np.array(table, "<u8").tobytes() + b"".join(sections)

    def log_units(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, p1: np.ndarray) -> np.ndarray:
        """Quantised -log10 p(w | u, v) of trigrams by word numbers, sorted by v; ``p1``: that of each word alone."""
        out = p1[w].astype(np.int64)
        heads = self.heads.values().astype(np.int64)
        ctx = np.searchsorted(heads, v)
        known = np.flatnonzero((ctx < len(heads)) & (heads[np.minimum(ctx, len(heads) - 1)] == v)) if len(heads) else np.zeros(0, np.int64)
        cut = 0
        while cut < len(known):
            lo = int(ctx[known[cut]])
            end = int(np.searchsorted(ctx[known], lo + BLOCK))
            rows = known[cut:end]
            out[rows] = self._block(lo, int(ctx[rows[-1]]) + 1, ctx[rows], u[rows], w[rows], p1)
            cut = end
        return out

    def _block(self, lo: int, hi: int, ctx: np.ndarray, u: np.ndarray, w: np.ndarray, p1: np.ndarray) -> np.ndarray:
        """For contexts lo to hi - 1: their levels are decoded, and each successor is sought between its context's pointers."""
        find = lambda level, key: (at := np.minimum(np.searchsorted(level, key), max(len(level) - 1, 0)), (level[at] == key) if len(level) else np.zeros(len(key), bool))
        next_at = self.next_at.slice(lo, hi + 1).astype(np.int64)
        level = self.next.slice(int(next_at[0]), int(next_at[-1])).astype(np.int64)
        at, seen2 = find(level, ctx * self.width + w)
        rank = at + next_at[0] - next_at[ctx - lo]
        units = np.where(seen2, self.p2[np.where(seen2, at + next_at[0], 0)].astype(np.int64), self.a2[ctx].astype(np.int64) + p1[w])
        before_at = self.before_at.slice(lo, hi + 1).astype(np.int64)
        b0, b1 = int(before_at[0]), int(before_at[-1])
        at, seen_u = find(self.before.slice(b0, b1).astype(np.int64), ctx * self.width + u)
        uv = at + b0
        last_at = self.last_at.slice(b0, b1 + 1).astype(np.int64)
        level = self.last.slice(int(last_at[0]), int(last_at[-1])).astype(np.int64)
        at, seen3 = find(level, uv * self.most + rank)
        seen3 &= seen2 & seen_u
        units = np.where(seen_u, units + self.a3[np.where(seen_u, uv, 0)], units)
        return np.where(seen3, self.p3[np.where(seen3, at + last_at[0], 0)].astype(np.int64), units)


def quantised(log10p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-log10p / UNIT), 0, 65535).astype(np.uint16)


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


_powers = np.ones(1, np.uint64)
_letters = mix64(np.arange(1, 257, dtype=np.uint64) * GOLDEN)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts, number of words of each): A-Z lowered, words parted by ASCII white space.

    A word's hash is a polynomial of its bytes over 64 bits, from running sums over the whole batch.
    """
    global _powers
    raw = [t.encode().lower() for t in texts]  # bytes: A-Z alone
    flat = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    step = np.uint64(0xD6E8FEB86659FD93)
    longest = 1 << 16
    if len(_powers) < longest:
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest - 1, step)]))
    gap = SPACE[flat]
    ends = np.flatnonzero(gap & ~np.append(True, gap[:-1]))
    starts = np.flatnonzero(~gap & np.append(True, gap[:-1]))
    size = ends - starts
    # sums of letter * step ** (place in the word): words longer than the table are hashed one by one
    terms = _letters[flat] * _powers[np.minimum(_places(starts, len(flat)), longest - 1)]
    total = np.append(np.uint64(0), np.cumsum(terms))
    h = mix64((total[ends] - total[starts]) ^ (size.astype(np.uint64) * GOLDEN))
    for k in np.flatnonzero(size > longest).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(flat[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    bounds = np.cumsum([len(r) + 1 for r in raw])
    n = np.diff(np.append(0, np.searchsorted(starts, bounds)))
    return h, n


def _places(starts: np.ndarray, n: int) -> np.ndarray:
    """For each byte its place in the word that began last."""
    out = np.arange(n)
    if len(starts):
        out[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, n)))
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed buffer: kinds and lengths, then bytes; 32-bit integers lie in two planes of 16 bits."""
    head, body = [], []
    for x in arrays:
        if x.dtype == np.uint32:
            head.append(f"p:{len(x)}")
            x = np.concatenate([x.astype(np.uint16), (x >> 16).astype(np.uint16)])
        else:
            head.append(f"{x.dtype.str[1:]}:{len(x)}")
        body.append(np.ascontiguousarray(x).tobytes())
    data = ",".join(head).encode() + b"\n" + b"".join(body)
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    data = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    head = data[: data.index(b"\n")]
    at, out = len(head) + 1, []
    for item in head.decode().split(","):
        kind, n = item.split(":")
        many = int(n) * (2 if kind == "p" else 1)
        x = np.frombuffer(data, np.uint16 if kind == "p" else kind, many, at) if many else np.zeros(0, np.uint32 if kind == "p" else kind)
        at += x.nbytes
        out.append(x[: int(n)] | (x[int(n) :].astype(np.uint32) << 16) if kind == "p" else x)
    return out


def _batched(batches):
    """Rows (batch, docs, words, tokens) from rows (doc_id, text)."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    ids, texts, size = [], [], 0

    def emit():
        # running sums take many times the text, so a batch is hashed by parts
        parts = [word_hashes(texts[a:b]) for a, b in in_batches(texts, 1 << 20, 1 << 18)]
        h, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        ends = np.cumsum(n)
        tokens = np.insert(h, ends, END)
        words, index = np.unique(tokens, return_inverse=True)
        none = np.array([i is None for i in ids])
        out = np.array([held_out(i) for i in ids])
        docs = _pack(np.array([i or 0 for i in ids], np.int64), none.astype(np.uint8), out.astype(np.uint8), (n + 1).astype(np.uint32))
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number]), pa.array([docs], pa.binary()), pa.array([words.tobytes()], pa.binary()), pa.array([_pack(index.astype(np.uint32))], pa.binary())], names=["batch", "docs", "words", "tokens"])

    for rows in batches:
        for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            ids.append(doc)
            texts.append(text)
            size += len(text)
            if size >= BATCH:
                yield emit()
                number, ids, texts, size = number + 1, [], [], 0
    if ids:
        yield emit()


def _each(batch: pa.RecordBatch):
    """Rows as dictionaries, one at a time."""
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _tokens(row) -> tuple[np.ndarray, ...]:
    """(ids, none, out, lens, words, tokens, document of each token) of a batch."""
    ids, none, out, lens = _unpack(row["docs"])
    words, tokens = np.frombuffer(row["words"], np.uint64), _unpack(row["tokens"])[0].astype(np.int64)
    return ids, none.astype(bool), out.astype(bool), lens, words, tokens, np.repeat(np.arange(len(lens)), lens.astype(np.int64))


def _word_counts(batches: DataFrame, parts: int) -> DataFrame:
    """(part, batch, c): training counts of each batch's words of each part; rows of batch -1: (sum, distinct, hot words)."""

    def deal(rows):
        for batch in rows:
            for row in _each(batch):
                _, _, out, _, words, tokens, doc = _tokens(row)
                n = np.bincount(tokens, ~out[doc], len(words)).astype(np.uint32)
                part = (words % np.uint64(parts)).astype(np.int64)
                pieces = [np.flatnonzero(part == k) for k in range(parts)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), pa.array([row["batch"]] * parts), pa.array([words[i].tobytes() for i in pieces], pa.binary()), pa.array([n[i].tobytes() for i in pieces], pa.binary())], names=["part", "batch", "w", "n"])

    def add(table: pa.Table) -> pa.Table:
        w, n = ([np.frombuffer(x, k) for x in table.column(c).to_pylist()] for c, k in (("w", np.uint64), ("n", np.uint32)))
        words, at = np.unique(np.concatenate(w), return_inverse=True)
        c = np.bincount(at, np.concatenate(n), len(words)).astype(np.uint64)
        cuts = np.cumsum([0] + [len(x) for x in w])
        hot = c > HOT
        about = _pack(np.array([c.sum(), (c > 0).sum()], np.uint64), words[hot], c[hot])
        part = table.column("part")[0].as_py()
        blobs = [_pack(c[at[a:b]]) for a, b in zip(cuts, cuts[1:])] + [about]
        return pa.table({"part": pa.array([part] * len(blobs), pa.int32()), "batch": pa.array([*table.column("batch").to_pylist(), -1], pa.int64()), "c": pa.array(blobs, pa.binary())})

    return batches.mapInArrow(deal, "part int, batch long, w binary, n binary").groupBy("part").applyInArrow(add, "part int, batch long, c binary")


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of ``x``, which is sorted in place, and how often each occurs."""
    x.sort()
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
    return x[first], np.diff(np.append(first, len(x)))


def shard_sums(blobs, pairs: tuple[np.ndarray, ...], is_hot, piece: int = PIECE) -> list[bytes]:
    """For each batch's packed trigrams of one shard, the packed sums of its documents.

    Contexts (v, u) are worked off in pieces of about ``piece`` trigrams, with a trie for each: beyond the trigrams themselves
    memory does not grow with the shard. ``pairs``: (v, w, count), by hashes, of the words that ``is_hot`` finds among hashes.
    """
    names = [_unpack(b.as_py())[0].copy() for b in blobs]  # not a view that keeps all of a batch
    words = np.unique(np.concatenate([*names, *pairs[:2]]))
    p1, size = np.zeros(len(words), np.uint16), max(1, len(words))
    rows = []
    for mine, blob in zip(names, blobs):
        _, unit, v, u, w, doc, train, docs = _unpack(blob.as_py())
        at = np.searchsorted(words, mine)
        p1[at] = unit
        rows.append((at[v] * size + at[u], at[w].astype(np.uint32), doc, train.astype(bool), int(docs[0])))
    del names
    hot = is_hot(words)
    contexts, many = _runs(np.concatenate([r[0] for r in rows]))
    own = []
    for vu, w, doc, train, _ in rows:
        v = vu // size
        k = np.flatnonzero(train[doc] & ~hot[v])
        own.append(v[k] * size + w[k])
    pair, pn = _runs(np.concatenate(own))
    del own
    if len(pairs[0]):
        # base probabilities of words that only the summed pairs have matter to no trigram here
        pair = np.append(pair, np.searchsorted(words, pairs[0]) * size + np.searchsorted(words, pairs[1]))
        order = np.argsort(pair, kind="stable")
        pair, pn = pair[order], np.append(pn, pairs[2])[order]
    sums = [np.zeros(r[4]) for r in rows]
    ends = np.cumsum(many)
    n = int(ends[-1]) if len(ends) else 0
    cuts = np.unique(np.append(np.searchsorted(ends, np.linspace(0, n, -(-n // piece) + 1)[1:-1]), [0, len(contexts)]))
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        some = contexts[a:b]
        picked = [np.flatnonzero((r[0] >= some[0]) & (r[0] <= some[-1])) for r in rows]
        keys = [np.searchsorted(some, r[0][k]) * size + r[1][k] for r, k in zip(rows, picked)]
        seen, count = _runs(np.concatenate([x[r[3][r[2][k]]] for x, r, k in zip(keys, rows, picked)]))
        v, u = np.divmod(some[seen // size], size)
        near = slice(*np.searchsorted(pair, (some[0] // size * size, (some[-1] // size + 1) * size)))
        trie = NgramTrie(NgramTrie.build(words, v, u, seen % size, count, (*np.divmod(pair[near], size), pn[near]), p1))
        asked = _runs(np.concatenate(keys))[0]
        v, u = np.divmod(some[asked // size], size)
        units = trie.log_units(v, u, asked % size, p1)
        for total, x, r, k in zip(sums, keys, rows, picked):
            total += np.bincount(r[2][k], units[np.searchsorted(asked, x)], len(total))
    return [_pack(total) for total in sums]


def score(docs: DataFrame, n_bytes: float = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    batches = scratch.table(rows.mapInArrow(_batched, "batch long, docs binary, words binary, tokens binary"), "batches")
    size = n_bytes or docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    parts = int(size // (64 << 20) + 8)
    counted = scratch.table(_word_counts(batches, parts), "counts")
    total = distinct = 0
    hot: dict[int, int] = {}  # at most one word for each HOT training tokens
    for r in counted.where("batch = -1").select("c").collect():  # one row a part
        sums, words, c = _unpack(r.c)
        total, distinct = total + int(sums[0]), distinct + int(sums[1])
        hot |= dict(zip(words.tolist(), (-(-c.astype(np.int64) // HOT)).tolist()))
    denominator = total + 0.5 * (distinct + 1)
    shards = int(max(total * 1.25 // SHARD, size // (6 * SHARD)) + 4)
    hot_words = np.array(sorted(hot), np.uint64)
    hot_parts = np.array([hot[h] for h in sorted(hot)], np.uint64)

    def shard_of(v: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return (mix64(mix64(v ^ GOLDEN) + salt * GOLDEN) % np.uint64(shards)).astype(np.int64)

    def parts_of(v: np.ndarray) -> np.ndarray:
        """Shards that a word's trigrams are dealt over."""
        if not len(hot_words):
            return np.ones(len(v), np.uint64)
        at = np.minimum(np.searchsorted(hot_words, v), len(hot_words) - 1)
        return np.where(hot_words[at] == v, hot_parts[at], np.uint64(1))

    def ready(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each batch with the counts of its words put together."""
        counts = {p: _unpack(c)[0] for p, c in zip(right.column("part").to_pylist(), right.column("c").to_pylist())}
        out = []
        for raw in left.column("words").to_pylist():
            words = np.frombuffer(raw, np.uint64)
            part, c = (words % np.uint64(parts)).astype(np.int64), np.zeros(len(words), np.uint64)
            for k in range(parts):
                c[part == k] = counts[k]
            out.append(_pack(c))
        return pa.table({n: left.column(n) for n in ("batch", "docs", "words", "tokens")} | {"c": pa.array(out, pa.binary())})

    counts = counted.where("batch >= 0")
    full = batches.groupBy("batch").cogroup(counts.groupBy("batch")).applyInArrow(ready, "batch long, docs binary, words binary, tokens binary, c binary")
    full = scratch.table(full, "ready")
    scratch.drop(batches)
    scratch.drop(counted)

    def asker(turn: int):
        """For mapInArrow: packed trigrams of the shards of this turn; in the first, also what is known of each document."""

        def run(frames):
            for frame in frames:
                for row in _each(frame):
                    out: list[tuple[int, bytes]] = []
                    ids, none, held, lens, words, tokens, doc = _tokens(row)
                    c = _unpack(row["c"])[0].astype(float)
                    logp = np.log10((c + 0.5) / denominator)
                    if turn == 0:
                        base = np.bincount(doc, logp[tokens], len(ids))
                        known = np.bincount(doc, c[tokens] > 0, len(ids)).astype(np.int64)
                        out.append((-1 - row["batch"] % shards, _pack(ids, none.astype(np.uint8), held.astype(np.uint8), lens, known, base)))
                    end = int(np.searchsorted(words, END))
                    v, u = np.roll(tokens, 1), np.roll(tokens, 2)
                    first = np.cumsum(lens.astype(np.int64)) - lens
                    v[first], u[first] = end, end
                    u[first[lens > 1] + 1] = end
                    split = parts_of(words)
                    shard = shard_of(words, np.zeros(len(words), np.uint64))[v]
                    far = np.flatnonzero((split > 1)[v])
                    shard[far] = shard_of(words[v[far]], mix64(words[u[far]]) % split[v[far]])
                    mine = np.flatnonzero(shard % ROUNDS == turn)
                    order = mine[np.argsort((shard[mine] * len(words) + v[mine]) * len(ids) + doc[mine])]
                    shard = shard[order]
                    cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[: len(shard)]), len(shard))
                    unit, train = quantised(logp), (~held).astype(np.uint8)
                    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                        e = order[a:b]
                        used, at = np.unique(np.concatenate([v[e], u[e], tokens[e]]), return_inverse=True)
                        p, q, r = at.reshape(3, -1).astype(np.uint32)
                        out.append((int(shard[a]), _pack(words[used], unit[used], p, q, r, doc[e].astype(np.uint32), train, np.array([len(ids)], np.uint32))))
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([row["batch"]] * len(out), pa.int64()), pa.array([o[1] for o in out], pa.binary())], names=["shard", "batch", "blob"])

        return run

    def hot_pairs(frames):
        for batch in frames:
            for row in _each(batch):
                _, _, held, lens, words, tokens, doc = _tokens(row)
                v = np.roll(tokens, 1)
                v[np.cumsum(lens.astype(np.int64)) - lens] = int(np.searchsorted(words, END))
                keep = np.flatnonzero((parts_of(words) > 1)[v] & ~held[doc])
                key, n = np.unique(v[keep] * len(words) + tokens[keep], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words[key // len(words)].astype(np.int64)), pa.array(words[key % len(words)].astype(np.int64)), pa.array(n.astype(np.int64))], names=["v", "w", "n"])

    def to_shards(frames):
        for batch in frames:
            v, w, n = (batch.column(k).to_numpy() for k in range(3))
            times = parts_of(v.astype(np.uint64)).astype(np.int64)
            at = np.repeat(np.arange(len(v)), times)
            salt = (np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(v[at].astype(np.uint64), salt).astype(np.int32)), pa.array(v[at]), pa.array(w[at]), pa.array(n[at])], names=["shard", "v", "w", "n"])

    pairs = spark.createDataFrame([], "shard int, v long, w long, n long")
    if len(hot_words):
        summed = full.mapInArrow(hot_pairs, "v long, w long, n long").groupBy("v", "w").agg(F.sum("n").alias("n"))
        pairs = scratch.table(summed.mapInArrow(to_shards, "shard int, v long, w long, n long").distinct(), "pairs")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or left.column("shard")[0].as_py() < 0:
            return left
        pairs = right.column("v").to_numpy().astype(np.uint64), right.column("w").to_numpy().astype(np.uint64), right.column("n").to_numpy()
        out = shard_sums(left.column("blob"), pairs, lambda words: parts_of(words) > 1)
        return pa.table({"shard": left.column("shard"), "batch": left.column("batch"), "blob": pa.array(out, pa.binary())})

    sums, turns = None, []
    for turn in range(ROUNDS):
        asked = full.mapInArrow(asker(turn), "shard int, batch long, blob binary")
        mine = pairs.where((F.col("shard") % ROUNDS == turn))
        got = scratch.table(asked.groupBy("shard").cogroup(mine.groupBy("shard")).applyInArrow(answer, "shard int, batch long, blob binary"), "sums")
        sums = got if sums is None else sums.union(got)
        turns.append(got)
    scratch.keep(*turns)

    def collect(table: pa.Table) -> pa.Table:
        about, units = None, 0.0
        for shard, blob in zip(table.column("shard").to_pylist(), table.column("blob").to_pylist()):
            got = _unpack(blob)
            if shard < 0:
                about = got
            else:
                units = units + got[0]
        ids, none, held, lens, known, base = about
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=none.astype(bool)), "held_out": held.astype(bool), "n_tokens": lens.astype(np.int64), "n_known": known, "train_tokens": np.full(len(ids), total, np.int64), "base_score": base, "score": -units * UNIT})

    return sums.groupBy("batch").applyInArrow(collect, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
