"""Embedding near-dedup: dual traversal of cover trees, exact threshold pairs.

1. Equal vectors of a label become one representative with a count.
2. The tree's upper level is shared: up to PIVOTS representatives, picked by hash among the largest labels, are centres;
   each representative belongs to its label's nearest centre. Cells whose covering radii and the link distance together
   fall short of their centres' distance never meet. A cell of more than BLOCK vectors is dealt by hash into blocks.
   A block's cover tree is built once: nested levels, halving radii, centres of one node further apart than its
   children's radius, down to leaves of LEAF vectors or of one.
3. A task has the trees of one pair of blocks that may meet, and walks both together: the children of a pair of nodes are paired,
   and a pair is dropped when its centres lie further apart than both covering radii and the link distance. Only pairs of
   leaves that are left are multiplied, in double precision.
4. A task returns link counts and a spanning forest, never all pairs; components come from the forests.

On vectors without clusters next to nothing can be ruled out, and work on one label grows with its square.

Representatives go by numbers of their own, so that null and shared ids neither merge classes nor lend each other links.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with a null label,
link with nothing and are kept; vectors of different length never link; repeated rows link with each other; a class goes by
its least id, and by null where it has none, in which case all its rows are kept; a row with a null id in a class that has
ids is not kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

BLOCK = 2048
SALT = 64
#: Centres of the shared level in all, vectors of one leaf, and slack for rounding of distances.
PIVOTS, LEAF, SLACK = 1024, 32, 1e-7
#: What is stored of a tree, by node: its slice, covering radius, and parent.
TREE = ("start", "stop", "cover", "parent")


class CoverTree:
    """Nodes over points in one order, each a slice whose first point is its centre; ``below``: the children of each."""

    def __init__(self, x: np.ndarray):
        self.order, self.nodes = np.arange(len(x)), []
        if len(x):
            self._grow(x, 0, len(x), 2.0, -1)
        self.x = x[self.order]
        self._numbered(*(np.array(c) for c in zip(*self.nodes)) if self.nodes else (np.zeros(0),) * 4)

    def _numbered(self, start, stop, cover, parent) -> None:
        self.start, self.stop, self.cover, self.parent = start.astype(np.int64), stop.astype(np.int64), cover.astype(float), parent.astype(np.int64)
        order = np.argsort(self.parent, kind="stable")
        at = np.searchsorted(self.parent[order], np.arange(len(order) + 1))
        self.below = [order[at[k] : at[k + 1]] for k in range(len(order))]

    @classmethod
    def stored(cls, x: np.ndarray, start, stop, cover, parent) -> CoverTree:
        tree = cls(x[:0])
        tree.x = x
        tree._numbered(start, stop, cover, parent)
        return tree

    def depth(self) -> int:
        levels = np.ones(len(self.parent), np.int64)
        for k in range(1, len(levels)):
            levels[k] = levels[self.parent[k]] + 1
        return int(levels.max(initial=0))

    def _grow(self, x: np.ndarray, a: int, b: int, radius: float, parent: int) -> None:
        mine = self.order[a:b]
        cover = float(np.sqrt(((x[mine] - x[mine[0]]) ** 2).sum(1).max()))
        number = len(self.nodes)
        self.nodes.append((a, b, cover, parent))
        if b - a <= LEAF or cover == 0:
            return
        while radius > cover:
            radius /= 2
        rest, parts = mine, []
        while len(rest):
            near = ((x[rest] - x[rest[0]]) ** 2).sum(1) <= radius * radius
            near[0] = True
            parts.append(rest[near])
            rest = rest[~near]
        self.order[a:b] = np.concatenate(parts)
        for part in parts:
            self._grow(x, a, a + len(part), radius / 2, number)
            a += len(part)


def close_pairs(tx: CoverTree, ty: CoverTree, reach: float, cosine: float, seen: dict | None = None):
    """(rows of tx, rows of ty) with at least ``cosine``, as arrays; with tx as ty, each pair is met once. ``seen`` counts pairs of
    nodes that were compared and dropped."""
    same = tx is ty
    stack, leaves = [(0, 0)] if len(tx.x) and len(ty.x) else [], []
    while stack:
        i, j = stack.pop()
        a, b = tx.below[i], ty.below[j]
        if not len(a) and not len(b):
            leaves.append((i, j))
            continue
        a, b = (a if len(a) else np.array([i])), (b if len(b) else np.array([j]))
        p, q = tx.x[tx.start[a]], ty.x[ty.start[b]]
        apart = np.sqrt(np.maximum(0.0, (p * p).sum(1)[:, None] + (q * q).sum(1) - 2 * p @ q.T))
        near = apart <= tx.cover[a][:, None] + ty.cover[b] + reach + SLACK
        if same and i == j:
            near = np.triu(near)
        if seen is not None:
            seen["met"] = seen.get("met", 0) + near.size
            seen["dropped"] = seen.get("dropped", 0) + int(near.size - near.sum())
        for k, m in np.argwhere(near).tolist():
            k, m = int(a[k]), int(b[m])
            (leaves if not len(tx.below[k]) and not len(ty.below[m]) else stack).append((k, m))
    # the leaves that one leaf meets are multiplied together
    leaves.sort()
    at = 0
    while at < len(leaves):
        i, end = leaves[at][0], at
        while end < len(leaves) and leaves[end][0] == i:
            end += 1
        cols = np.concatenate([np.arange(ty.start[j], ty.stop[j]) for _, j in leaves[at:end]])
        p, q = np.nonzero(tx.x[tx.start[i] : tx.stop[i]] @ ty.x[cols].T >= cosine)
        p, q = p + tx.start[i], cols[q]
        if same:
            p, q = p[p < q], q[p < q]
        yield p, q
        at = end


def unit(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.array(vectors)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index reachable, by repeated minimum over links."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding_dedup")
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fine = F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists("v", lambda c: c != 0), F.lit(False))
    v = v.withColumn("fine", fine)
    reps = v.where("fine").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    reps = scratch.table(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    reach = float(np.sqrt(2 - 2 * threshold))
    # the shared level: centres in proportion to their labels' sizes, PIVOTS rows at most
    sizes = reps.groupBy("label").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    wanted = sizes.orderBy(F.desc("n"), "label").limit(PIVOTS // 2).withColumn("k", F.least(F.ceil(F.col("n") / BLOCK), F.floor(F.col("n") * (PIVOTS // 2) / total) + 1).cast("int"))
    # of a share of each label that holds about eight times the centres wanted, those of least hash
    nth = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("v", "rep"), "rep"))
    some = F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), F.floor(F.col("n") / (8 * F.col("k"))))) == 0
    pivots = reps.join(F.broadcast(wanted.select("label", "k", "n")), "label").where(some).withColumn("nth", nth).where("nth <= k").select("label", "nth", "v")
    chosen: dict = {}
    for r in pivots.collect():
        chosen.setdefault((r.label, len(r.v)), []).append(np.array(r.v))
    centres = {key: unit(vs) for key, vs in chosen.items()}
    label_type = v.schema["label"].dataType.simpleString()

    def cell(batches):
        for batch in batches:
            labels, vectors = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cells, far = np.zeros(len(labels), np.int32), np.full(len(labels), 2.0)
            groups: dict = {}
            for k, (label, vec) in enumerate(zip(labels, vectors)):
                groups.setdefault((label, len(vec)), []).append(k)
            for key, rows in groups.items():
                if key in centres:
                    x = unit([np.array(vectors[k], float) for k in rows])
                    dot = x @ centres[key].T
                    at = dot.argmax(1)
                    cells[rows] = at
                    far[rows] = np.sqrt(((x - centres[key][at]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(w) for w in vectors], pa.int32()), pa.array(cells), pa.array(far)], names=[*batch.schema.names, "dims", "cell", "far"])

    placed = reps.select("label", "v", "rep", "copies").mapInArrow(cell, f"label {label_type}, v array<double>, rep long, copies long, dims int, cell int, far double")
    placed = scratch.table(placed, "placed")
    about = placed.groupBy("label", "dims", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.max("far").alias("radius"))
    dealt = placed.join(about.drop("radius"), ["label", "dims", "cell"]).withColumn("block", F.pmod(F.xxhash64("v", "rep"), F.col("blocks")).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        one = {c: table.column(c).slice(0, 1) for c in ("label", "dims", "cell", "block")}
        tree = CoverTree(unit([np.array(a, "<f8") for a in table.column("v").to_pylist()]))
        there = {c: [table.column(c).to_numpy()[tree.order]] for c in ("rep", "copies")}
        return pa.table({**one, **there, "v": [tree.x.tobytes()], **{c: [getattr(tree, c)] for c in TREE}})

    kinds = f"label {label_type}, dims int, cell int, block int, rep array<long>, copies array<long>, v binary, start array<long>, stop array<long>, cover array<double>, parent array<long>"
    packed = dealt.groupBy("label", "dims", "cell", "block").applyInArrow(pack, kinds)
    packed = scratch.table(packed, "blocks")

    def meet(table: pa.Table) -> pa.Table:
        """Pairs of cells of one label that may hold a link: of PIVOTS cells at most."""
        label, dims = table.column("label")[0].as_py(), table.column("dims")[0].as_py()
        cells, blocks, radius = (table.column(c).to_numpy() for c in ("cell", "blocks", "radius"))
        c = centres.get((label, dims))
        near = np.ones((len(cells),) * 2, bool)
        if c is not None:
            apart = np.sqrt(np.maximum(0.0, 2 - 2 * c[cells] @ c[cells].T))
            near = (apart <= radius[:, None] + radius + reach + SLACK) | np.eye(len(cells), dtype=bool)
        i, j = np.nonzero(near & (cells[:, None] <= cells))
        return pa.table({"label": pa.array([label] * len(i), table.schema.field("label").type), "dims": pa.array([dims] * len(i), pa.int32()), "ci": cells[i], "cj": cells[j], "ni": blocks[i], "nj": blocks[j]})

    met = about.groupBy("label", "dims").applyInArrow(meet, f"label {label_type}, dims int, ci int, cj int, ni int, nj int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    met = met.withColumn("bi", each("ni")).withColumn("bj", each("nj")).where("ci <> cj or bi <= bj")
    pairs = scratch.table(met.select("label", "dims", "ci", "bi", "cj", "bj", F.monotonically_increasing_id().alias("pair")), "pairs")
    ends = [pairs.select("label", "dims", "pair", F.col(f"c{e}").alias("cell"), F.col(f"b{e}").alias("block")) for e in "ij"]
    sides = packed.join(ends[0].union(ends[1]).distinct(), ["label", "dims", "cell", "block"])

    def unpack(table: pa.Table, k: int):
        entry = lambda c: table.column(c)[k].values.to_numpy()
        rep = entry("rep")
        return rep, entry("copies"), CoverTree.stored(np.frombuffer(table.column("v")[k].as_py(), "<f8").reshape(len(rep), -1), *(entry(c) for c in TREE))

    def compare(table: pa.Table) -> pa.Table:
        got = [unpack(table, k) for k in range(table.num_rows)]
        (ra, ca, tx), (rb, cb, ty) = got[0], got[-1]
        once = len(got) == 1
        ids = ra if once else np.concatenate([ra, rb])
        links, shift, p, q = np.zeros(len(ids), np.int64), 0 if once else len(ra), [], []
        for i, j in close_pairs(tx, ty, reach, threshold):
            links[: len(ra)] += np.bincount(i, cb[j], len(ra)).astype(np.int64)
            links[shift : shift + len(rb)] += np.bincount(j, ca[i], len(rb)).astype(np.int64)
            p.append(i)
            q.append(j + shift)
        root = _forest(len(ids), *(np.concatenate(w) if w else np.zeros(0, np.int64) for w in (p, q)))
        hit = links > 0
        return pa.table({"id": ids[hit], "links": links[hit], "root": ids[root][hit]})

    found = scratch.table(sides.groupBy("label", "dims", "pair").applyInArrow(compare, "id long, links long, root long"), "found")
    classes = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    placed = reps.select("rep", "least").join(classes, F.col("rep") == classes.id).select("rep", "component", "least")
    named = scratch.table(placed.groupBy("component").agg(F.min("least").alias("name")), "names")
    classes = scratch.table(placed.join(named, "component").select(F.col("rep").alias("id"), "name"), "classes")
    scratch.keep(reps, found, classes)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    per_rep = reps.join(links, reps.rep == links.id, "left").drop("id").join(classes, F.col("rep") == classes.id, "left")
    per_rep = per_rep.select(F.xxhash64("label", "v").alias("h"), F.col("label").alias("rl"), F.col("v").alias("rv"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(F.col("id").isNull(), F.col("least")).otherwise(F.col("name")).alias("component_id"), F.explode(F.sequence(F.lit(0), F.when(F.col("copies") > SALT, SALT - 1).otherwise(0))).alias("salt"), (F.col("copies") > SALT).alias("hot"))
    members = v.withColumn("h", F.xxhash64("label", "v"))
    spread = per_rep.select("h", "rl", "rv", "n_links", "component_id", F.col("salt"), "hot")
    own = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(SALT)).cast("int")
    # a representative with many copies is there once for each salt, others at salt 0 only
    wide = spread.where("hot").withColumnRenamed("salt", "s")
    thin = spread.where("not hot").withColumnRenamed("salt", "s")
    m = members.withColumn("own", own)
    match = lambda r: (m.h == r.h) & (m.label == r.rl) & (m.v == r.rv) & m.fine
    w = m.join(wide, match(wide) & (m.own == wide.s), "left").select(m.vec_id, m.label, m.v, m.fine, m.h, "n_links", "component_id")
    rest = w.where("n_links is null")
    easy = rest.select("vec_id", "label", "v", "fine", "h").join(thin.withColumnRenamed("h", "h2"), (F.col("h") == F.col("h2")) & (F.col("label") == F.col("rl")) & (F.col("v") == F.col("rv")) & F.col("fine"), "left").select("vec_id", "n_links", "component_id")
    out = w.where("n_links is not null").select("vec_id", "n_links", "component_id").union(easy)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
