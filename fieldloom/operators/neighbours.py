"""Nearest-neighbour joins of targets with sources (observations, or simulated nodes that come earlier).

Sources are dealt into leaves of a k-d tree whose splits are medians of a bounded sample, so that each leaf has about as many
sources wherever they lie; a leaf that one place fills is parted by hash. Exact boxes and counts of the leaves, a bounded
table, are sent to the targets. A target goes to leaves best first: to the nearest box, and, once it has its k sources,
to just those boxes that reach nearer than its k-th; one that still lacks sources goes to ever more. Targets are dealt anew and
sorted by place, so that a few dozen of them, which lie together, look at the leaves about them and not at all of the table.
Leaves that many targets visit are copied for chunks of them. Sources of a number that one broadcast may hold (SMALL rows) go to
all targets.

Along a path only earlier nodes count. Sources lie in bands of the path, each four times as long as all before, with a tree for
each; a target first goes to one leaf of every band that begins before it, so all but the last band hold just what it may use.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rotation import transform, transformed
from . import boxes
from .staging import stage

#: Sources that are sent to all targets, after they were counted; more meet by leaves.
SMALL = 8192
#: Sources of a leaf, and leaves of a tree at most (their boxes are sent to all targets); rows of the sample that its splits are taken from.
LEAF, LEAVES, SAMPLE = 1024, 16_384, 200_000
#: Visits of one leaf that a task takes; positions of the first band of a path; targets that look at leaves together.
VISITS, STRETCH, TOGETHER = 16_384, 1 << 15, 128


@dataclass(frozen=True)
class Search:
    """How one variable's neighbours are sought: the nearest ``nmax`` in a space turned and scaled like a model's (ratios
    of the minor ranges by the major one), then those within ``maxdist`` there; with ``sectors`` the nearest of each
    quadrant or octant. ``time_at`` scales the last dimension, time, which no sector tells apart."""

    nmax: int = 16
    maxdist: float | None = None
    ratio1: float = 1.0
    ratio2: float = 1.0
    azimuth: float = 0.0
    dip: float = 0.0
    plunge: float = 0.0
    sectors: bool = False
    time_at: float | None = None

    def __post_init__(self):
        if self.nmax < 1 or self.ratio1 <= 0 or self.ratio2 <= 0 or (self.maxdist is not None and self.maxdist < 0):
            raise ValueError("a search needs nmax >= 1, positive ratios and a distance that is not negative")

    def columns(self, coordinates: list[Column]) -> list[Column]:
        """Coordinates in search space. Without anisotropy nothing is turned."""
        space = coordinates if self.time_at is None else coordinates[:-1]
        if self.ratio1 != 1.0 or self.ratio2 != 1.0:
            space = transformed(transform(len(space), self.ratio1, self.ratio2, self.azimuth, self.dip, self.plunge), space)
        return space if self.time_at is None else [*space, coordinates[-1] * F.lit(self.time_at)]


def _found(t: pa.Table, o: pa.Table, n: int, k: int, ordered: bool, sector_dims: int, names: list[str]) -> pa.Table:
    """The k nearest of ``o`` for each row of ``t``, as far as its bound. ``o`` has to be in the order of its sides."""
    tx, sx = (np.stack([x.column(f"{side}{i}").to_numpy() for i in range(n)], 1) for x, side in ((t, "t"), (o, "s")))
    before = (t.column("t_ord").to_numpy(), o.column("s_ord").to_numpy()) if ordered else None
    rows, cols, d2 = boxes.search(tx, sx, k, t.column("bound").to_numpy(), before)
    out = {"block_id": t.column("block_id").take(pa.array(rows)), "d2": pa.array(d2)}
    if sector_dims:
        out["sector"] = pa.array(sum(((sx[cols, i] < tx[rows, i]).astype(np.int32) << i) for i in range(sector_dims)).astype(np.int32))
    picked = o.take(pa.array(cols))
    return pa.table({c: out[c] if c in out else picked.column(c) for c in names})


def _nearest(t: DataFrame, o: DataFrame, k: int, n: int, maxdist: float | None, ordered: bool, sides: list[str], carry: list[str], sector_dims: int) -> DataFrame:
    """``t`` (block_id, t0.., [t_ord]) with its k nearest of ``o`` (sides.., carry.., s0.., [s_ord]): d2, rank[, sector]."""
    spark = t.sparkSession
    names = ["block_id", *sides, "d2", *(["sector"] if sector_dims else []), *carry]
    kinds = {**{f.name: f.dataType.simpleString() for f in o.schema}, "block_id": t.schema["block_id"].dataType.simpleString(), "d2": "double", "sector": "int"}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    limit = float("inf") if maxdist is None else float(maxdist) ** 2
    best = F.row_number().over(Window.partitionBy("block_id").orderBy("d2", *sides))
    o = o.withColumn("band", _band() if ordered else F.lit(0))
    counts = _counts(o)
    if sum(counts.values()) <= SMALL:
        sent = spark.sparkContext.broadcast(o.drop("band").orderBy(*sides).toArrow())

        def meet(batches):
            for batch in batches:
                if batch.num_rows and sent.value.num_rows:
                    yield from _found(pa.Table.from_batches([batch]), sent.value, n, k, ordered, sector_dims, names).to_batches()

        met = t.repartition("block_id").withColumn("bound", F.lit(limit)).mapInArrow(meet, schema)
        return met.withColumn("rank", best)
    return _by_leaves(t, o, counts, k, n, limit, ordered, sides, sector_dims, names, schema)


def _band() -> Column:
    """0 for what comes before the path, then bands of it."""
    at = F.greatest(F.lit(0.0), F.ceil(F.log(4.0, F.col("s_ord") / float(STRETCH))).cast("double"))
    return F.when(F.col("s_ord") <= 0, F.lit(0)).otherwise((at + 1).cast("int"))


def _counts(o: DataFrame) -> dict[int, int]:
    """Sources by band, of which there are few."""
    return {r.band: r.n for r in o.groupBy("band").agg(F.count("*").alias("n")).collect()}


def leaves_of(o: DataFrame, n: int, ordered: bool, sides: list[str], counts: dict[int, int] | None = None) -> tuple[DataFrame, dict]:
    """``o`` with ``leaf``, and the leaves' boxes, counts and first places in the path as arrays (two times LEAVES a band at most),
    with the tree of the largest band."""
    spark = o.sparkSession
    at = [f"s{i}" for i in range(n)]
    o = o if "band" in o.columns else o.withColumn("band", F.lit(0))
    counts = counts or _counts(o)
    share = F.element_at(F.create_map(*(F.lit(v) for band, m in counts.items() for v in (band, min(1.0, SAMPLE / m)))), F.col("band"))
    sample = o.select("band", *at).where(F.rand(7) < share).toPandas()
    trees, sizes, shift = {}, {}, 0
    for band, m in sorted(counts.items()):
        wanted = int(min(LEAVES, max(2, m // LEAF)))
        tree = boxes.splits(sample.loc[sample.band == band, at].to_numpy(float)[: 2 * SAMPLE], wanted)
        trees[band], sizes[band] = (shift, tree), -(-m // wanted)
        shift += len(tree[0]) + 1
    ends = sorted(first for first, _ in trees.values())
    size = [sizes[band] for band in sorted(trees)]

    def place(batches):
        for batch in batches:
            x = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in at], 1)
            bands = batch.column(batch.schema.get_field_index("band")).to_numpy()
            leaf = np.zeros(len(x), np.int32)
            for band in np.unique(bands):
                mine = bands == band
                leaf[mine] = trees[band][0] + boxes.descend(trees[band][1], x[mine])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in o.schema)
    placed = stage(o.mapInArrow(place, f"{schema}, leaf int"))
    limits = [f(c).alias(f"{name}{c}") for c in at for name, f in (("lo", F.min), ("hi", F.max))]
    about = lambda p: p.groupBy("leaf").agg(F.count("*").alias("n"), *limits, (F.min("s_ord") if ordered else F.lit(0)).alias("since")).orderBy("leaf").toPandas()
    found = about(placed)
    # leaves that cannot be parted by place, such as one of many sources at one spot, are parted by hash
    parts = np.array([-(-m // (2 * size[int(np.searchsorted(ends, leaf, "right")) - 1])) for leaf, m in zip(found.leaf, found.n)], int)
    if (parts > 1).any():
        first = np.zeros(shift, int)
        first[found.leaf.to_numpy()] = parts
        first = np.cumsum(first) - first
        numbers = spark.createDataFrame([(int(leaf), int(first[leaf]), int(p)) for leaf, p in zip(found.leaf, parts)], "leaf int, __first int, __parts int")
        part = F.pmod(F.xxhash64(*sides), F.col("__parts"))
        placed = placed.join(F.broadcast(numbers), "leaf").withColumn("leaf", (F.col("__first") + part).cast("int")).drop("__first", "__parts")
        found = about(placed)
    low, high = (found[[f"{name}{c}" for c in at]].to_numpy(float) for name in ("lo", "hi"))
    return placed.drop("band"), {"leaf": found.leaf.to_numpy(), "low": low, "high": high, "n": found.n.to_numpy(), "since": found.since.to_numpy(), "tree": trees[max(counts, key=counts.get)][1]}


def dealt(t: DataFrame, known, n: int, dims: list[str], ordered: bool = False) -> DataFrame:
    """Targets dealt out by number, neighbours in place one after another; with ``ordered``, those of one band of the path."""

    def zone(batches):
        for batch in batches:
            x = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in dims], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(boxes.descend(known.value["tree"], x))], names=[*batch.schema.names, "zone"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.schema)
    return t.repartition("block_id").mapInArrow(zone, f"{schema}, zone int").sortWithinPartitions(*_together(ordered))


def _together(ordered: bool) -> list[Column]:
    return [*([F.floor(F.log2(F.greatest(F.col("t_ord"), F.lit(1))))] if ordered else []), F.col("zone")]


def _by_leaves(t: DataFrame, o: DataFrame, counts: dict[int, int], k: int, n: int, limit: float, ordered: bool, sides: list[str], sector_dims: int, names: list[str], schema: str) -> DataFrame:
    spark = t.sparkSession
    o, known = leaves_of(o, n, ordered, sides, counts)
    sent = spark.sparkContext.broadcast(known)
    order = ["t_ord"] if ordered else []
    at = [f"t{i}" for i in range(n)]
    state = ["block_id", *at, *order, "bound"]
    left = stage(dealt(t.select(*state[:-1]), sent, n, at, ordered).withColumns({"bound": F.lit(limit), "full": F.lit(False), "seen": F.lit(0)}))
    left_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema if f.name in state)
    best = F.row_number().over(Window.partitionBy("block_id").orderBy("d2", *sides))
    found, step = None, len(counts)

    def visits_of(step: int):
        """Each target once for each leaf that it goes to now."""

        def run(batches):
            leaf, low, high, since = (sent.value[c] for c in ("leaf", "low", "high", "since"))
            for batch in batches:
                column = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                x, picked_rows, picked_leaves = np.stack([column(c) for c in at], 1), [], []
                bounds, fulls, seens, orders = column("bound"), column("full"), column("seen"), column("t_ord") if ordered else None
                for start in range(0, len(x), TOGETHER):
                    some = slice(start, start + TOGETHER)
                    bound, full, seen = bounds[some], fulls[some], seens[some]
                    lacking = int(seen[~full].max()) + step if not full.all() else 0
                    open_ = since < orders[some].min() if ordered else None
                    near_by = boxes.about(x[some], low, high, bound[full].max() if full.any() else -np.inf, lacking, open_, bound[~full].max() if lacking else np.inf)
                    if ordered:
                        near_by = near_by[since[near_by] < orders[some].max()]
                    near = boxes.distances(x[some], low[near_by], high[near_by])
                    if ordered:
                        near[since[near_by] >= orders[some, None]] = np.inf
                    there = np.argsort(near, 1, kind="stable")
                    sorted_near = np.take_along_axis(near, there, 1)
                    place = np.arange(len(near_by))
                    go = (sorted_near <= bound[:, None]) & np.isfinite(sorted_near) & (place >= seen[:, None]) & (full[:, None] | (place < seen[:, None] + step))
                    rows, cols = np.nonzero(go)
                    picked_rows.append(rows + start)
                    picked_leaves.append(leaf[near_by[there[rows, cols]]].astype(np.int32))
                if picked_rows:
                    picked = batch.select(state).take(pa.array(np.concatenate(picked_rows)))
                    yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(np.concatenate(picked_leaves))], names=[*state, "leaf"])

        return run

    def meet(t: pa.Table, o: pa.Table) -> pa.Table:
        # ties go to the first of the sides
        return _found(t, o.sort_by([(c, "ascending") for c in sides]), n, k, ordered, sector_dims, names)

    while True:
        visits = stage(left.mapInArrow(visits_of(step), f"{left_schema}, leaf int"))
        loads = visits.groupBy("leaf").agg(F.count("*").alias("n")).collect()  # one row a leaf
        if not loads:
            break
        chunks = F.broadcast(spark.createDataFrame([(r.leaf, -(-r.n // VISITS)) for r in loads], "leaf int, __chunks int"))
        going = visits.join(chunks, "leaf").withColumn("chunk", F.pmod(F.xxhash64("block_id"), F.col("__chunks")).cast("int")).drop("__chunks")
        there = o.join(chunks, "leaf").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1))).drop("__chunks")
        met = going.groupBy("leaf", "chunk").cogroup(there.groupBy("leaf", "chunk")).applyInArrow(meet, schema)
        met = met if found is None else met.unionByName(found.drop("rank"))
        found = stage(met.withColumn("rank", best).where(F.col("rank") <= k))
        kth = found.groupBy("block_id").agg(F.count("*").alias("__n"), F.max("d2").alias("__far"))
        left = left.where(~F.col("full")).join(kth, "block_id", "left")
        full = F.coalesce(F.col("__n") == k, F.lit(False))
        bound = F.when(full, F.col("__far")).otherwise(F.col("bound"))
        left = left.select(*state[:-1], "zone", bound.alias("bound"), full.alias("full"), (F.col("seen") + step).alias("seen"))
        left = stage(left.sortWithinPartitions(*_together(ordered)))
        step *= 4
    return (visits.limit(0).mapInArrow(lambda b: iter(()), f"{schema}, rank int") if found is None else found)


def neighbours(targets: DataFrame, sources: DataFrame, dims: list[str], search: Search, exclude_self: bool = False, sides: tuple[str, ...] = ("obs_id",), order: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(block_id, sides.., d2, rank[, sector], carry..). ``order``: a column of both sides; only sources before the target count.
    ``carry``: columns of the sources that come along.

    Rows with a null coordinate have no neighbours and are none; ties go to the least of ``sides``. ``exclude_self`` leaves
    out the source whose ``obs_id`` is the target's ``block_id``.
    """
    n = len(dims)
    there = F.lit(True)
    for d in dims:
        there = there & F.col(d).isNotNull() & ~F.isnan(F.col(d).cast("double"))
    if order:
        there = there & F.col(order).isNotNull()
    at = search.columns([F.col(d).cast("double") for d in dims])
    along = lambda name: [F.col(order).cast("long").alias(name)] if order else []
    t = targets.where(there).select("block_id", *(c.alias(f"t{i}") for i, c in enumerate(at)), *along("t_ord"))
    o = sources.where(there).select(*sides, *carry, *(c.alias(f"s{i}") for i, c in enumerate(at)), *along("s_ord"))
    space = n - (search.time_at is not None)
    k = search.nmax * 4 * 2**space if search.sectors else search.nmax
    near = _nearest(t, o, k + exclude_self, n, search.maxdist, order is not None, list(sides), list(carry), space if search.sectors else 0)
    if exclude_self:
        # of the nearest k + 1 the target itself goes, or else the farthest; sectors count it among their candidates
        near = near.where((F.col("rank") <= k) if search.sectors else F.lit(True)).where(F.col(sides[-1]) != F.col("block_id"))
        again = Window.partitionBy("block_id").orderBy("d2", *sides)
        near = near.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= k)
    if search.sectors:
        rank = F.row_number().over(Window.partitionBy("block_id", "sector").orderBy("d2", *sides))
        near = near.withColumn("rank", rank).where(F.col("rank") <= search.nmax)
    return near.select("block_id", *sides, "d2", *(["sector"] if search.sectors else []), "rank", *carry)


def knn(targets: DataFrame, obs: DataFrame, k: int, dims: list[str], maxdist: float | None = None, exclude_self: bool = False) -> DataFrame:
    """(block_id, obs_id, d2, rank) of the k nearest observations, ties by obs_id, then within ``maxdist``."""
    return neighbours(targets, obs, dims, Search(k, maxdist), exclude_self)


def sector_knn(targets: DataFrame, obs: DataFrame, k: int, dims: list[str], search: Search | None = None) -> DataFrame:
    """The k nearest of each sector (signs of the offsets), among the k * 4 * 2^n nearest of all."""
    return neighbours(targets, obs, dims, search or Search(k, sectors=True))
