"""MinHash near-dedup: DartMinHash signatures of weighted word shingles, banded joining, exact check.

Elements are five-word shingles, weighted by their count in the text (a shorter text is one shingle). Each unit of
an element's weight is a region of its own; a hashed Poisson process throws darts into it, ordered by rank, and a
dart's height says which weights it lies under. Ranks are opened up to a bound that doubles until every
coordinate has a dart; the earliest dart of each coordinate is the signature.  Agreement per coordinate has the
probability of the weighted Jaccard similarity. The darts of a batch of texts are thrown together.

Only signatures are staged for all rows; shingle sets are made anew, from whole texts, for the texts that share a
bucket. Equal texts are one. Shingles that one candidate alone holds can be in no overlap, so they bound its similarity
to all others: a text whose other shingles fall short of the threshold, with the least partner that its bucket has,
leaves that bucket. Nothing that could link is lost by it.

A band's bucket is worked off in two steps. In each of CENTRES rounds, the member outside the bucket's largest class that
shares most with others is compared with all members, so that large groups of copies link by few comparisons. Members
still outside the largest class of a bucket then look for all partners by their rarest shingles: order the shingles of all
texts of such buckets by frequency; two texts that reach the threshold have one in common among the first
T - need + 1 of their T, where need is the least overlap that a partner takes. So every two members of a bucket are
compared, or ruled out by these bounds, or known to be of one class. Components of the links are the classes.

Defined results: null and empty texts are one group of equal texts; repeated rows are copies, and of each class one
row is kept, with the class's least id. A class without an id, and one whose least id names another class already (an
id with several texts), is named by a negative number from its least text hash. An empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, mix64
from .components import components

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BANDS, ROWS = 24, 4
#: Rounds in which a bucket's members meet a centre; bytes of shingles that are dealt out together.
CENTRES, DEALT = 3, 1 << 23
#: Shingles whose frequencies one task counts, about.
PART_SHINGLES = 1_000_000
#: Words whose hashes a worker remembers; texts whose darts are thrown together, and their characters.
MEMO, TOGETHER, CHARS = 200_000, 64, 1 << 19

_hashes: dict[str, int] = {}


def _word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    new = {w for w in words if w not in _hashes}
    if len(_hashes) + len(new) > MEMO:
        _hashes.clear()
        new = set(words)
    for w in new:
        _hashes[w] = xxhash.xxh3_64_intdigest(w)
    out = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    if len(_hashes) > MEMO:
        _hashes.clear()
    return out


def shingles(text: str, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(element hashes, ascending, and their weights)."""
    words = text.split()
    h = _word_hashes(words)
    n = max(1, len(h) - width + 1)
    size = min(width, len(h))
    gram = np.full(n, size, np.uint64)
    for k in range(size):
        gram = gram * GOLDEN + h[k : k + n]
    return np.unique(mix64(gram), return_counts=True)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def dart_minhash(sets: list[tuple[np.ndarray, np.ndarray]], k: int = BANDS * ROWS) -> np.ndarray:
    """For each weighted set k coordinates, each the identity of the earliest dart below its element's weight."""
    elements, weights = np.concatenate([e for e, _ in sets]), np.concatenate([w for _, w in sets]).astype(float)
    owner = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
    cells = np.ceil(weights).astype(np.int64)
    element, owner = np.repeat(elements, cells), np.repeat(owner, cells)
    cell = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    room = np.repeat(weights, cells) - cell  # the share of the cell that lies under the weight
    state = mix64(mix64(element + GOLDEN * (cell.astype(np.uint64) + np.uint64(1))))
    bound = k * (np.log(k) + 2) / np.bincount(owner, room, len(sets))
    nxt = -np.log(_uniform(state))
    best, sig = np.full(len(sets) * k, np.inf), np.zeros(len(sets) * k, np.uint64)
    where = np.arange(len(owner))
    while True:
        # arrivals of each cell's process, in rank order, up to the bound
        now = where
        while len(now := now[nxt[now] <= bound[owner[now]]]):
            ident = mix64(state[now] ^ GOLDEN)
            under = np.flatnonzero(_uniform(mix64(ident + GOLDEN)) < room[now])
            slot = owner[now[under]] * k + (ident[under] % np.uint64(k)).astype(np.int64)
            rank, ident = nxt[now[under]], ident[under]
            old = best[slot]
            np.minimum.at(best, slot, rank)
            first = np.flatnonzero((rank == best[slot]) & (rank < old))
            sig[slot[first]] = ident[first]
            state[now] = mix64(state[now] + GOLDEN)
            nxt[now] += -np.log(_uniform(state[now]))
        open_sets = np.isinf(best).reshape(-1, k).any(1)
        if not open_sets.any():
            return sig.reshape(-1, k)
        bound[open_sets] *= 2
        where = where[open_sets[owner[where]]]


def _bands(sig: np.ndarray) -> np.ndarray:
    s = sig.reshape(-1, BANDS, ROWS)
    band = mix64(s[:, :, 0] + np.arange(1, BANDS + 1, dtype=np.uint64))
    for k in range(1, ROWS):
        band = mix64(band ^ s[:, :, k])
    return band.astype(np.int64)


def _sign(batches):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and end - at < TOGETHER and chars < CHARS:
                chars += len(texts[end])
                end += 1
            digest = [hashlib.sha256(t.encode()).digest()[:16] for t in texts[at:end]]
            one = dict(zip(digest, texts[at:end]))  # copies are signed once
            sets = [shingles(t) for t in one.values()]
            bands = _bands(dart_minhash(sets))
            place = {d: i for i, d in enumerate(one)}
            row = [place[d] for d in digest]
            total = np.array([int(w.sum()) for _, w in sets])[row]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * BANDS, pa.int32()), pa.array(bands[row].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(digest, pa.binary()), pa.array(total), lists], names=["doc_id", "h", "total", "bands"])
            at = end


def _shingled(batches):
    for batch in batches:
        got = [shingles(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e.tobytes() for e, _ in got], pa.binary()), pa.array([w.astype("<i4").tobytes() for _, w in got], pa.binary())], names=["t", "elements", "weights"])


def _similar(a: bytes, wa: bytes, b: bytes, wb: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    p, q = np.frombuffer(wa, np.int32), np.frombuffer(wb, np.int32)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    hit = np.flatnonzero(y[at] == x)
    low = int(np.minimum(p[hit], q[at[hit]]).sum())
    return low / (int(p.sum()) + int(q.sum()) - low)


def _dealt(sets: DataFrame, parts: int, of) -> DataFrame:
    """(part, t, e, w): the elements of ``sets`` (t, elements, weights), packed by part; ``of`` makes (elements, weights) of a row's two."""

    def rows_of(held: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        t = np.repeat(np.array([h[0] for h in held], np.int64), [len(h[1]) for h in held])
        e, w = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        part = (e % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        pieces = [order[cuts[i] : cuts[i + 1]] for i in range(parts)]
        cols = [[x[i].tobytes() for i in pieces] for x in (t, e, w)]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), *(pa.array(c, pa.binary()) for c in cols)], names=["part", "t", "e", "w"])

    def deal(batches):
        held, size = [], 0
        for batch in batches:
            for t, e, w in zip(*(batch.column(k).to_pylist() for k in range(3))):
                held.append((t, *of(np.frombuffer(e, np.uint64), np.frombuffer(w, np.int32))))
                size += held[-1][1].nbytes
                if size > DEALT:
                    yield rows_of(held)
                    held, size = [], 0
        if held:
            yield rows_of(held)

    return sets.mapInArrow(deal, "part int, t binary, e binary, w binary")


def _unpacked(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in (("t", np.int64), ("e", np.uint64), ("w", np.int32))]


def _alone(sets: DataFrame, parts: int) -> DataFrame:
    """(t, alone): the weight of each text's elements that no other text of ``sets`` holds."""

    def once(table: pa.Table) -> pa.Table:
        t, e, w = _unpacked(table)
        order = np.argsort(e)
        s = e[order]
        fresh = np.append(True, s[1:] != s[:-1])[: len(s)]
        single = order[fresh & np.append(fresh[1:], True)[: len(s)]]
        text, at = np.unique(t[single], return_inverse=True)
        return pa.table({"t": text, "alone": np.bincount(at, w[single], len(text)).astype(np.int64)})

    dealt = _dealt(sets, parts, lambda e, w: (e, w))
    return dealt.groupBy("part").applyInArrow(once, "t long, alone long").groupBy("t").agg(F.sum("alone").alias("alone"))


def _occurrences(e: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One element of weight 1 for each unit of weight."""
    turn = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
    return mix64(np.repeat(e, w) + GOLDEN * turn.astype(np.uint64)), np.ones(len(turn), np.int32)


def _partners(sets: DataFrame, members: DataFrame, threshold: float, parts: int = 8, keep=lambda df: df) -> DataFrame:
    """(x, y) texts that may reach the threshold, x open. ``members``: (t, total, least, open, component), one row a text.
    ``parts``: tasks that count shingles; ``keep`` stages a table that is read twice."""

    def shared(table: pa.Table) -> pa.Table:
        """Each text's elements that others hold too, with how many texts do, one row a text."""
        t, e, _ = _unpacked(table)
        _, at, df = np.unique(e, return_inverse=True, return_counts=True)
        many = np.flatnonzero(df[at] > 1)
        many = many[np.argsort(t[many], kind="stable")]
        text, first = np.unique(t[many], return_index=True)
        cuts = np.append(first, len(many))
        cols = [[x[many[i:j]].tobytes() for i, j in zip(cuts[:-1], cuts[1:])] for x in (df[at].astype(np.int64), e)]
        return pa.table({"t": text, **{c: pa.array(v, pa.binary()) for c, v in zip(("df", "e"), cols)}})

    need = F.ceil((F.col("total") + F.greatest("least", F.col("total") * threshold)) * (threshold / (1 + threshold)) - 1e-9)
    names = ["t", "total", "open", "component"]

    def rarest(batches):
        """Of the T - need + 1 rarest, those that no other text has come first; the others as rows, with how many are left from each on."""
        for batch in batches:
            rows, elements, ahead = [], [], []
            for i, (needed, dfs, es) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4, 7)))):
                df, e = np.frombuffer(b"".join(dfs), np.int64), np.frombuffer(b"".join(es), np.uint64).astype(np.int64)
                room = max(0, len(e) - needed + 1)
                rows.append(np.full(room, i))
                elements.append(e[np.lexsort((e, df))[:room]])
                ahead.append(len(e) - np.arange(room))
            if rows:
                rows, elements, ahead = (np.concatenate(c).astype(np.int64) for c in (rows, elements, ahead))
                kept = batch.select(names).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(elements), pa.array(ahead)], names=[*names, "e", "ahead"])

    held = _dealt(sets.join(members.select("t"), "t").select("t", "elements", "weights"), parts, _occurrences)
    # elements stay packed, one row a text and part, so that no join has a row for each of them
    listed = held.groupBy("part").applyInArrow(shared, "t long, df binary, e binary").groupBy("t").agg(F.collect_list(F.struct("df", "e")).alias("l"))
    listed = members.join(listed, "t").select(*names, need.cast("long").alias("need"), F.col("l.df").alias("df"), F.col("l.e").alias("e"))
    kinds = ", ".join(f"{c} {members.schema[c].dataType.simpleString()}" for c in names)
    # at their first common shingle, no more overlap is left than the shared shingles from there on
    first = keep(listed.mapInArrow(rarest, f"{kinds}, e long, ahead long"))
    x, y = (first.select("e", *(F.col(c).alias(f"{c}_{n}") for c in ("t", "total", "open", "component", "ahead"))) for n in "xy")
    close = F.least("total_x", "total_y") >= F.greatest("total_x", "total_y") * (threshold - 1e-9)
    close = close & (F.least("ahead_x", "ahead_y") >= (F.col("total_x") + F.col("total_y")) * (threshold / (1 + threshold)) - 1e-9)
    once = (F.col("t_x") < F.col("t_y")) | ~F.col("open_y")  # two open texts meet once
    met = x.where("open_x").join(y, "e").where((F.col("component_x") != F.col("component_y")) & close & once)
    return met.groupBy("t_x", "t_y").agg(F.first("component_x").alias("cx"), F.first("component_y").alias("cy")).select(F.col("t_x").alias("x"), F.col("t_y").alias("y"), "cx", "cy")


def _checked(sets: DataFrame, todo: DataFrame, threshold: float) -> DataFrame:
    """``todo`` (a, b, further columns) with ``ok``: whether the whole sets of a and b reach the threshold."""
    names = todo.columns

    def check(batches):
        for batch in batches:
            parts = [batch.column(k).to_pylist() for k in range(len(names), len(names) + 4)]
            ok = [_similar(*p) >= threshold for p in zip(*parts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(ok, pa.bool_())], names=[*names, "ok"])

    x = sets.select(F.col("t").alias("a"), F.col("elements").alias("ea"), F.col("weights").alias("wa"))
    y = sets.select(F.col("t").alias("b"), F.col("elements").alias("eb"), F.col("weights").alias("wb"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in todo.schema) + ", ok boolean"
    return todo.join(x, "a").join(y, "b").select(*names, "ea", "wa", "eb", "wb").mapInArrow(check, schema)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id, kept) of every row; a class is named by its least doc_id; one row of it is kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    signed = scratch.table(plain.mapInArrow(_sign, "doc_id long, h binary, total long, bands array<long>"), "signed")
    texts = signed.groupBy("h").agg(F.min("doc_id").alias("rep"), F.first("total").alias("total"), F.first("bands").alias("bands"))
    texts = scratch.table(texts.withColumn("t", F.monotonically_increasing_id()), "texts")
    rows = texts.select("t", "total", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    rows = scratch.table(rows.join(shared, ["band", "key"]), "buckets")
    wanted = rows.select("t").distinct().join(texts.select("t", "h"), "t")
    digest = F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32))
    found = plain.select(digest.alias("h"), "text").join(wanted, "h").dropDuplicates(["t"])
    sets = scratch.table(found.select("t", "text").mapInArrow(_shingled, "t long, elements binary, weights binary"), "sets")
    # what a text shares with any other candidate bounds each of its similarities
    held = rows.select("t", "total").distinct().agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    parts = int(max(8, held // PART_SHINGLES + 1))
    rows = rows.join(scratch.table(_alone(sets, parts), "alone"), "t", "left")
    rows = rows.withColumn("shared", F.col("total") - F.coalesce("alone", F.lit(0))).drop("alone")
    least = rows.where(F.col("shared") >= F.col("total") * (threshold - 1e-9)).groupBy("band", "key").agg(F.min("total").alias("least"), F.count("*").alias("n")).where("n > 1")
    partner = F.greatest("least", F.col("total") * (threshold - 1e-9))
    rows = rows.join(least.drop("n"), ["band", "key"]).where(F.col("shared") * (1 + threshold) >= (F.col("total") + partner) * (threshold - 1e-9))
    rows = scratch.table(rows.select("t", "total", "shared", "band", "key"), "linkable")
    classes = None

    def merge(todo: DataFrame) -> DataFrame:
        """Checks pairs (a, b, ca, cb) and merges the classes that the links join."""
        checked = scratch.table(_checked(sets, todo, threshold), "checked")
        merged = components(checked.where("ok").select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch)
        if classes is not None:
            later = merged.select(F.col("id").alias("component"), F.col("component").alias("further"))
            moved = classes.join(later, "component", "left").select("id", F.coalesce("further", "component").alias("component"))
            merged = moved.union(merged.join(classes.select("id"), "id", "left_anti"))
        return scratch.table(merged, "merged")

    for turn in range(CENTRES + 1):
        at = rows.withColumn("component", F.col("t"))
        if classes is not None:
            at = rows.join(classes, rows.t == classes.id, "left").select(*rows.columns, F.coalesce("component", "t").alias("component"))
        sizes = at.groupBy("band", "key", "component").agg(F.count("*").alias("n"))
        largest = sizes.groupBy("band", "key").agg(F.max(F.struct("n", "component"))["component"].alias("largest"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
        # buckets of one class are done with; members of the largest class are partners only
        at = at.join(largest, ["band", "key"]).withColumn("open", F.col("component") != F.col("largest")).drop("largest")
        at = scratch.table(at, "open")
        if at.isEmpty():
            break
        if turn == CENTRES:
            least = at.groupBy("band", "key").agg(F.min("total").alias("least"))
            members = at.join(least, ["band", "key"]).groupBy("t", "component").agg(F.max("total").alias("total"), F.min("least").alias("least"), F.max("open").alias("open"))
            todo = _partners(sets, scratch.table(members, "members"), threshold, parts, lambda df: scratch.table(df, "rarest"))
            classes = merge(todo.select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("cx").alias("ca"), F.col("cy").alias("cb")))
            break
        best = F.min(F.struct((-F.col("shared") / F.col("total")).alias("share"), "t", "total", "shared", "component"))
        centre = at.where(F.col("open") | F.lit(turn == 0)).groupBy("band", "key").agg(best.alias("p"))
        centre = centre.select("band", "key", *(F.col(f"p.{c}").alias(f"p_{c}") for c in ("t", "total", "shared", "component")))
        enough = (threshold - 1e-9) * (F.col("total") + F.col("p_total"))
        close = (F.least("total", "p_total") >= F.greatest("total", "p_total") * (threshold - 1e-9)) & (F.least("shared", "p_shared") * (1 + threshold) >= enough)
        met = at.join(centre, ["band", "key"]).where((F.col("component") != F.col("p_component")) & close)
        ends = F.struct(F.col("t").alias("id"), "component"), F.struct(F.col("p_t").alias("id"), F.col("p_component").alias("component"))
        todo = met.select(F.least(*ends).alias("x"), F.greatest(*ends).alias("y")).distinct()
        classes = merge(todo.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.component").alias("ca"), F.col("y.component").alias("cb")))
        rows = at.select("t", "total", "shared", "band", "key")
    table = texts.select(F.hex("h").alias("h"), "rep", F.col("t").alias("class"))
    if classes is not None:
        table = texts.join(classes, texts.t == classes.id, "left").select(F.hex("h").alias("h"), "rep", F.coalesce("component", "t").alias("class"))
    # the kept text of a class: of least id, then of least hash; a class without an id has only its hash
    table = scratch.table(table, "classes")
    least = table.groupBy("class").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "h")).alias("f"), F.min("h").alias("least_h"))
    least = scratch.table(least.select("class", F.col("f.rep").alias("first_id"), F.col("f.h").alias("first_h"), "least_h"), "named")
    owners = least.where("first_id is not null").groupBy("first_id").agg(F.min("least_h").alias("owner"))
    number = -1 - F.conv(F.substring("least_h", 1, 15), 16, 10).cast("long")
    named = least.join(owners, "first_id", "left").select("class", "first_id", "first_h", F.when(F.col("owner") == F.col("least_h"), F.col("first_id")).otherwise(number).alias("component_id"))
    scratch.keep(signed, table, least)
    rows = signed.select("doc_id", F.hex("h").alias("h")).join(table.join(named, "class").select("h", "first_id", "first_h", "component_id"), "h")
    first = (F.col("h") == F.col("first_h")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    once = F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("component_id")) == 1
    return rows.withColumn("kept", first & once).select("doc_id", "component_id", "kept")
