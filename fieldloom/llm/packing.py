"""Packing: cutting-stock column generation over a histogram of piece lengths.

1. Documents are tokenized whole and cut into pieces: full sequences, and one remainder.
2. Remainders fall into length classes of ``grain`` tokens. A linear program over patterns (multisets of
   classes that fit a sequence) covers the class histogram; an unbounded-knapsack dynamic program prices new
   columns from the duals until none improves (Gilmore and Gomory). Only the histogram reaches the driver.
3. Patterns are rounded down, and what is left of the histogram is placed by best fit decreasing.
4. Pieces are ranked within their class (longest first) by a chunked distributed rank; rank and the patterns'
   running counts decide each piece's sequence and place.

Defined results: a null text counts as empty and has its end id alone; repeated rows and tied ids are pieces
of their own, in no fixed order among equals; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, dense_rank_rows
from .tokens import encoder, in_batches

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, seq_len: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the piece's ids as little-endian uint32 bytes."""
    end = np.array([end_id], "<u4").tobytes()
    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids

    def run(batches):
        own, step = encoder(tokenizer, "<u4"), 4 * seq_len
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids, rows = batch.column(0).to_pylist(), []
            for a, b in in_batches(texts, 256, 1 << 20):
                for doc, raw in zip(ids[a:b], own.encode(texts[a:b])):
                    raw += end
                    for at in range(0, len(raw), step):
                        cut = raw[at : at + step]
                        rows.append((doc, at // 4, len(cut) // 4, zlib.crc32(cut), len(raw) // 4) + (cut,) * with_ids)
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 5 else pa.binary()) for k, c in enumerate(columns)], names=names)
        own.memo.clear()

    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))
    return rows.mapInArrow(run, PIECES + ", ids binary" * with_ids)


def best_pattern(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: classes 1..len(value), worth value[i - 1], size i."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        most = min(room, len(value))
        worth = best[room - 1 :: -1][:most] + value[:most]
        k = int(np.argmax(worth))
        if worth[k] > best[room - 1]:
            best[room], took[room] = worth[k], k + 1
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(value), np.int64), capacity
    while room:
        pattern[took[room] - 1] += took[room] > 0
        room -= max(1, took[room])
    return float(best[capacity]), pattern


def greedy_basis(demand: np.ndarray, capacity: int) -> np.ndarray:
    """A feasible first basis, patterns as columns over the classes: each pattern takes the longest pieces left
    and repeats until one of its classes is used up. Classes that end together get a pattern of their own, so
    the patterns are triangular in the order of the classes' ends."""
    left, basis = demand.astype(float), []
    while (left > 0).any():
        room, pattern = capacity, np.zeros(len(demand))
        while len(fits := np.flatnonzero((left[:room] > 0) & (pattern[:room] == 0))):
            i = int(fits[-1])
            pattern[i] = max(1, min(room // (i + 1), int(left[i])))
            room -= int(pattern[i]) * (i + 1)
        has = np.flatnonzero(pattern)
        ratio = left[has] / pattern[has]
        left[has] -= ratio.min() * pattern[has]
        over = has[(ratio == ratio.min()) | (left[has] < 1e-9)]
        left[over] = 0
        basis.append(pattern)
        for i in over[1:]:
            basis.append(np.where(np.arange(len(demand)) == i, capacity // (i + 1), 0.0))
    return np.array(basis).T


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row exchange; no threaded library call, which can block in a driver that has forked."""
    n = len(a)
    work = np.hstack([a.astype(float), np.eye(n)])
    for c in range(n):
        r = c + int(np.argmax(np.abs(work[c:, c])))
        if r != c:
            work[[c, r]] = work[[r, c]]
        work[c] /= work[c, c]
        factor = work[:, c].copy()
        factor[c] = 0.0
        work -= factor[:, None] * work[c]
    return work[:, n:]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(1)


def cutting_stock(demand: np.ndarray, capacity: int, tolerance: float = 1e-3, rounds: int = 4_000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as rows over the classes, how often each is used): covers ``demand`` exactly in integers.

    ``demand[i]``: pieces of class i + 1. Revised simplex over the classes that occur, from greedy patterns,
    with smoothed duals, until within ``tolerance`` of the bound that the priced duals prove; then rounding
    down, and best fit decreasing of the rest, which is at most a few pieces a pattern.
    """
    live = np.flatnonzero(demand)
    if not len(live):
        return np.zeros((0, len(demand)), np.int64), np.zeros(0, np.int64)
    need = demand[live].astype(float)
    basis = greedy_basis(demand, capacity)[live]
    inverse = _inverse(basis)
    use = np.maximum(_times(inverse, need), 0)
    value, best, bound = np.zeros(len(demand)), None, 0.0
    for k in range(1, rounds):
        duals = np.maximum(inverse.sum(0), 0)
        for trial in (duals,) if best is None else (0.7 * best + 0.3 * duals, duals):
            value[live] = trial
            gain, pattern = best_pattern(value, capacity)
            column = pattern[live].astype(float)
            if (proved := need @ trial / max(gain, 1e-12)) > bound or best is None:
                bound, best = proved, trial / max(gain, 1e-12)
            if inverse.sum(0) @ column > 1 + 1e-9:
                break
        else:
            break
        if use.sum() <= bound * (1 + tolerance):
            break
        step = _times(inverse, column)
        up = step > 1e-9
        out = int(np.argmin(np.where(up, use / np.where(up, step, 1), np.inf)))
        ratio = use[out] / step[out]
        use -= ratio * step
        use[out] = ratio
        np.maximum(use, 0, out=use)
        basis[:, out] = column
        if k % 100:
            pivot = inverse[out] / step[out]
            inverse -= step[:, None] * pivot
            inverse[out] = pivot
        else:
            inverse = _inverse(basis)
            use = np.maximum(_times(inverse, need), 0)
    patterns, left, times = [], demand.astype(np.int64).copy(), []
    for j in np.argsort(-use):
        pattern = np.zeros(len(demand), np.int64)
        pattern[live] = np.rint(basis[:, j]).astype(np.int64)
        has = pattern > 0
        n = min(int(use[j] + 1e-9), int((left[has] // pattern[has]).min()))
        if n > 0:
            patterns.append(pattern)
            times.append(n)
            left -= n * pattern
    rooms: list[tuple[int, np.ndarray]] = []
    for i in range(len(demand) - 1, -1, -1):
        for _ in range(int(left[i])):
            fits = [k for k, (room, _) in enumerate(rooms) if room >= i + 1]
            k = min(fits, key=lambda k: rooms[k][0]) if fits else len(rooms)
            if not fits:
                rooms.append((capacity, np.zeros(len(demand), np.int64)))
            room, pattern = rooms[k]
            pattern[i] += 1
            rooms[k] = (room - i - 1, pattern)
    return np.array(patterns + [p for _, p in rooms]).reshape(-1, len(demand)), np.array(times + [1] * len(rooms), np.int64)


def assignment(patterns: np.ndarray, times: np.ndarray) -> dict[int, tuple[np.ndarray, ...]]:
    """For each class: first rank of each run, its copies a sequence, its first sequence, its first slot."""
    first_sequence = np.cumsum(times) - times
    out = {}
    for i in range(patterns.shape[1]):
        rows = np.flatnonzero(patterns[:, i])
        if len(rows):
            copies = patterns[rows, i]
            ranks = np.cumsum(copies * times[rows])
            slots = patterns[rows, i + 1 :].sum(1)  # longer classes come first
            out[i + 1] = (ranks - copies * times[rows], copies, first_sequence[rows], slots)
    return out


def pack(pieces: DataFrame, seq_len: int = 2048, grain: int = 8) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows (doc_id, start, length, ...); a staged table is expected."""
    classes = -(-seq_len // grain)
    pieces = pieces.withColumn("__class", F.ceil(F.col("length") / grain).cast("int"))
    demand = np.zeros(classes, np.int64)
    for r in pieces.groupBy("__class").count().collect():  # at most ``classes`` rows
        demand[r["__class"] - 1] = r["count"]
    where = assignment(*cutting_stock(demand, seq_len // grain))
    ranked = dense_rank_rows(pieces, "__class", [F.desc("length"), "doc_id", "start"], int(demand.sum()), [F.col("doc_id"), F.col("start")], "__rank")

    def run(batches):
        for batch in batches:
            kind, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("__class", "__rank"))
            sequence, slot = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
            for c in np.unique(kind).tolist():
                first, copies, base, at = where[c]
                mine = np.flatnonzero(kind == c)
                k = np.searchsorted(first, rank[mine], "right") - 1
                inside = rank[mine] - first[k]
                sequence[mine], slot[mine] = base[k] + inside // copies[k], at[k] + inside % copies[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(slot)], names=[*batch.schema.names, "sequence_id", "__slot"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    placed = ranked.mapInArrow(run, fields + ", sequence_id long, __slot long")
    before = Window.partitionBy("sequence_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    return placed.withColumn("offset", offset).drop("__class", "__rank", "__slot")


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, seq_len: int = 2048, grain: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenizes, cuts and packs; one row per piece."""
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.table(token_pieces(docs, tokenizer, end_id, seq_len, id_col, text_col), "pieces"), seq_len, grain)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves from pieces with ``ids``: (sequence_id, ids array<int>, doc_ids)."""

    def run(batches):
        for batch in batches:
            joined = [np.frombuffer(b"".join(x), "<u4").astype(np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(joined, pa.list_(pa.int32())), batch.column(2)], names=["sequence_id", "ids", "doc_ids"])

    rows = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    return rows.select("sequence_id", "p.ids", F.col("p.doc_id").alias("doc_ids")).mapInArrow(run, "sequence_id long, ids array<int>, doc_ids array<long>")
