"""Conversation prefix trie: the nodes of all common beginnings, by a range sort, adjacent LCPs and a stack sweep.

1. Turns are numbered in their conversation by running counts over ranges, and each conversation is rebuilt from the
   first turns of another and its own (``rebuilt``). A turn is known by 128 bits of its role and text.
2. Turn arrays are cut into segments of SEGMENT turns, so that no row holds a long conversation whole; a segment's group is what
   comes before it, by a running fingerprint. Segments are sorted globally by ranges of (number, group, turns,
   conversation), so copies are neighbours and a group of any size is spread over ranges.
3. Each range is swept once. The LCP with the row before closes the nodes on the stack that the row is not part of, and opens
   those below it. What a node needs is a sum over its members, so it flows down the stack as nodes close: members,
   least id, leaves, and tokens up to the LCP, which are the tokens that a member shares. Long conversations add what their later
   segments share, found by a sweep over those alone.
4. Nodes that reach over a border of ranges (the border's LCP tells which: at most SEGMENT + 1 at either end of a range) are
   given out in parts, which are stitched by their keys; nodes below them learn of their parent by (range, key).

The hash of a node's ends is a sequential function of all ids; of a node that spans ranges, they are packed in rows of up to
CHUNK ids, and streamed in order through one hash, never held together.

Defined results: null role and text are empty; turns without a conv_id belong to no conversation; turns of equal number are
ordered by role and text (its first 64 characters, then its hash); repeated rows are turns of their own; a conversation of
which no turn is left is a member of the root; an empty table has no nodes; further columns are ignored. The remainder of a
negative id is negative, as in SQL.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.staging import stage
from .common import Scratch

SEGMENT, CHUNK = 64, 4096
#: Turns that conversations may borrow: the greatest remainder by BORROW.
BORROW, FAMILY = 6, 100
NO_ENDS = hashlib.sha256(b"").hexdigest()
ORDER = ["seg", "before", "keys", "more", "c"]
NODE = "kind int, part int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, idx int"
#: Kinds of rows that a sweep gives out: a whole node, one whose parent spans ranges, a part of one that spans, ends of such.
WHOLE, BELOW, PART, ENDS = range(4)


def running(df: DataFrame, key: str, order: list[Column], sums: dict[str, Column], scratch: Scratch, name: str) -> DataFrame:
    """``df`` with sums over the rows of the same ``key`` that come earlier; keys are split by ranges of their order."""
    values = df.select("*", *(v.alias(f"__{n}") for n, v in sums.items()))
    ranged = scratch.table(values.repartitionByRange(key, *order).withColumn("__chunk", F.spark_partition_id()), name)
    earlier = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(key, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(key, "__chunk").agg(*(F.sum(f"__{n}").alias(f"__{n}") for n in sums))
    bases = totals.select(key, "__chunk", *(F.sum(f"__{n}").over(earlier).alias(f"__base_{n}") for n in sums))
    zero = {n: F.lit(0).cast(ranged.schema[f"__{n}"].dataType) for n in sums}
    placed = ranged.join(bases, [key, "__chunk"])
    placed = placed.select("*", *((F.coalesce(F.col(f"__base_{n}"), zero[n]) + F.coalesce(F.sum(f"__{n}").over(inside), zero[n])).alias(n) for n in sums))
    return placed.drop("__chunk", *(f"__{n}" for n in sums), *(f"__base_{n}" for n in sums))


def rebuilt(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(c, pos, key, chars) of all rebuilt turns, and (c, len) of all conversations: the first h turns of conversation c - c % FAMILY,
    then what comes after c's own first h; h is crc32 of c modulo BORROW."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    plain = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), "turn", role.alias("role"), F.substring(text, 1, 64).alias("head"), key.alias("key"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))
    order = [F.col(x) for x in ("turn", "role", "head", "key", "row")]
    turns = running(plain, "c", order, {"at": F.lit(1).cast("long")}, scratch, "turns")
    turns = scratch.table(turns.select("c", (F.col("at") + 1).alias("pos"), "key", "chars"), "numbered")
    first = turns.where(F.col("pos") < BORROW)
    lent = first.groupBy(F.col("c").alias("base")).agg(F.max("pos").alias("there"))
    h = F.crc32(F.col("c").cast("string")) % BORROW
    convs = turns.groupBy("c").agg(F.count("*").alias("n")).withColumn("h", h).withColumn("base", F.col("c") - F.col("c") % FAMILY)
    convs = convs.join(lent, "base", "left").withColumn("b", F.least("h", F.coalesce("there", F.lit(0).cast("long"))))
    convs = scratch.table(convs.select("c", "base", "h", "b", (F.greatest(F.col("n") - F.col("h"), F.lit(0)) + F.col("b")).alias("len")), "convs")
    own = turns.where(F.col("pos") > h).join(convs, "c").select("c", (F.col("pos") - F.col("h") + F.col("b")).alias("pos"), "key", "chars")
    borrowed = convs.join(first.withColumnRenamed("c", "base"), "base").where("pos <= h").select("c", "pos", "key", "chars")
    return own.unionByName(borrowed), convs.select("c", "len")


def segments(turns: DataFrame, convs: DataFrame, scratch: Scratch, segment: int = SEGMENT) -> DataFrame:
    """(c, seg, keys, chars, more, before, after): ``more`` turns follow; fingerprints of what lies before and up to the end."""
    seg = F.floor((F.col("pos") - 1) / segment).cast("int").alias("seg")
    cut = turns.groupBy("c", seg).agg(F.sort_array(F.collect_list(F.struct("pos", "key", "chars"))).alias("t"))
    rows = convs.join(cut, "c", "left").select("c", "len", F.coalesce("seg", F.lit(0)).alias("seg"), F.coalesce("t.key", F.array().cast("array<binary>")).alias("keys"), F.coalesce("t.chars", F.array().cast("array<bigint>")).alias("chars"))
    rows = scratch.table(rows.withColumn("more", (F.col("seg") + 1) * segment < F.col("len")), "segments")
    names = ["c", "seg", "keys", "chars", "more", "before", "after"]
    short = rows.where(F.col("len") < segment).select("c", "seg", "keys", "chars", "more", F.lit("").alias("before"), F.lit("").alias("after"))
    long = rows.where(F.col("len") >= segment)
    if long.isEmpty():
        return short
    prints = {f"f{k}": F.xxhash64(F.lit(k), "seg", "keys").cast("decimal(20,0)") for k in (1, 2)}
    summed = running(long, "c", [F.col("seg")], prints, scratch, "prints")
    before = F.when(F.col("seg") == 0, "").otherwise(F.concat_ws(",", *(F.col(n).cast("string") for n in prints)))
    after = F.concat_ws(",", *((F.col(n) + p).cast("string") for n, p in prints.items()))
    return short.unionByName(summed.select(*names[:5], before.alias("before"), after.alias("after")))


def _common(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _rows(batches):
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)))


def sort_segments(rows: DataFrame) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """Segments in ranges of ORDER, and for each range the LCP of its first row with the row before, and of the next range's
    first with its last: two numbers a range (-1: another group, or none)."""
    ranged = stage(rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER))

    def ends(batches):
        first = last = None
        for row in _rows(batches):
            first, last = first or row, row
        if first:
            part = TaskContext.get().partitionId()
            columns = [[part], [first[0]], [first[1]], [first[2]], [last[0]], [last[1]], [last[2]]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*kinds, *kinds[1:]])], names=["part", "seg", "before", "keys", "seg1", "before1", "keys1"])

    borders = ranged.select("seg", "before", "keys").mapInArrow(ends, "part int, seg int, before string, keys array<binary>, seg1 int, before1 string, keys1 array<binary>")
    prev = Window.orderBy("part")  # one row a range
    lagged = borders.select("part", "seg", "before", "keys", *(F.lag(f"{c}1").over(prev).alias(f"{c}1") for c in ("seg", "before", "keys")))
    differ = F.array_position(F.zip_with("keys", "keys1", lambda a, b: a.eqNullSafe(b)), F.lit(False))
    lcp = F.when((F.col("seg") == F.col("seg1")) & (F.col("before") == F.col("before1")), F.when(differ == 0, F.size("keys").cast("long")).otherwise(differ - 1)).otherwise(-1)
    found = sorted((r.part, int(r.lcp)) for r in lagged.select("part", lcp.alias("lcp")).collect())
    after = [x[1] for x in found[1:]] + [-1]
    return ranged, {part: (first, then) for (part, first), then in zip(found, after)}


def _shared_later(links):
    """For mapInArrow over sorted later segments: tokens that each shares with the row before it, and whether it ends in a leaf."""

    def run(batches):
        first, then = links.value.get(TaskContext.get().partitionId(), (-1, -1))
        out, held, prev = [], None, None
        for c, seg, keys, chars, more, before in _rows(batches):
            lcp = first if prev is None else _common(keys, prev[2]) if (seg, before) == prev[:2] else -1
            if held:
                out.append((*held[:3], not held[3] and lcp < held[4]))
            held, prev = (c, seg, sum(chars[: max(lcp, 0)]), more, len(keys)), (seg, before, keys)
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
        if held:
            out.append((*held[:3], not held[3] and then < held[4]))
            yield _batch(out)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.bool_()))], names=["c", "seg", "shared", "leaf"])

    return run


def with_later(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` with what long conversations need of their later segments: ``later``, tokens shared there by members that are
    not the first, and ``leaf``, whether the conversation ends in a leaf (null where its own segment tells)."""
    deep = rows.where("seg > 0")
    none = [F.lit(0).cast("long").alias("later"), F.lit(None).cast("boolean").alias("leaf")]
    if deep.isEmpty():
        return rows.select("*", *none)
    ranged, links = sort_segments(deep)
    sent = rows.sparkSession.sparkContext.broadcast(links)
    shared = scratch.table(ranged.select("c", "seg", "keys", "chars", "more", "before").mapInArrow(_shared_later(sent), "c long, seg int, shared long, leaf boolean"), "shared")
    total = shared.groupBy("c").agg(F.sum("shared").alias("all"), F.max("leaf").alias("leaf"))
    passed = running(shared, "c", [F.col("seg")], {"passed": F.col("shared")}, scratch, "passed").select("c", "seg", (F.col("passed") + F.col("shared")).alias("passed"))
    both = rows.join(total, "c", "left").join(passed, ["c", "seg"], "left")
    later = F.coalesce(F.col("all") - F.coalesce("passed", F.lit(0)), F.lit(0)).cast("long")
    return both.select(*(rows[c] for c in rows.columns), later.alias("later"), total["leaf"].alias("leaf"))


class _Sweep:
    """The nodes of one range. Lists by node: each node has the number at which it was opened."""

    def __init__(self, part: int, first: int, then: int, segment: int, chunk: int):
        self.part, self.first, self.then, self.segment, self.chunk = part, first, then, segment, chunk
        self.stack: list[int] = []
        self.depth, self.parent, self.base, self.begins = [], [], [], []
        self.n, self.least, self.children, self.leaves, self.tokens = [], [], [], [], []
        self.more, self.spans, self.key, self.ends = [], [], [], {}
        self.row, self.flushed = None, []

    def open(self, depth: int, base: int, begins: bool, seg: int) -> None:
        at = len(self.depth)
        parent = self.stack[-1] if self.stack else -1
        if parent >= 0 and begins:
            self.children[parent] += 1
        self.depth.append(seg * self.segment + depth)
        self.parent.append(parent)
        self.base.append(base)
        self.begins.append(begins)
        for x in (self.n, self.children, self.leaves, self.tokens):
            x.append(0)
        self.least.append(None)
        self.more.append(False)
        self.spans.append(not begins)
        self.key.append(None)
        self.stack.append(at)

    def close(self, spans: bool) -> None:
        """The deepest open node is done with; its sums go to the one above."""
        at = self.stack.pop()
        seg, before, keys, after = self.row
        d, up = len(self.stack), self.parent[at]
        root = d == 0 and seg > 0  # a later segment's group: the node itself is given out by the segment before
        self.spans[at] = self.spans[at] or spans or self.more[at] or root
        if self.spans[at]:
            # a segment's last node goes by the fingerprint that later segments have; others by their turns
            self.key[at] = before.encode() if d == 0 else after.encode() if d == self.segment else hashlib.blake2b(f"{seg}|{before}|".encode() + b"".join(keys[:d]), digest_size=16).digest()
        if up >= 0:
            self.n[up] += self.n[at]
            self.leaves[up] += self.leaves[at]
            self.tokens[up] += self.tokens[at]
            if self.least[up] is None or self.least[at] < self.least[up]:
                self.least[up] = self.least[at]
        # of members that are not the first: tokens up to their LCP, less those before this node
        saved = self.tokens[at] - (self.n[at] - self.begins[at]) * self.base[at]
        ids = self.ends.pop(at, [])
        self.flushed.append((at, saved, ids, root))

    def add(self, c, seg, keys, chars, more, before, after, later, leaf, then: int | None) -> None:
        prev = self.row
        if prev is None:
            lcp = self.first
        else:
            lcp = _common(keys, prev[2]) if (seg, before) == prev[:2] else -1
            while len(self.stack) > lcp + 1:
                self.close(False)
        self.row = (seg, before, keys, after)
        begin = len(self.stack)
        base = [0, 0]
        for x in chars:
            base.append(base[-1] + x)
        for d in range(begin, len(keys) + 1):
            self.open(d, base[d], prev is not None or d > lcp, seg)
        at = self.stack[len(keys)]
        self.n[at] += 1
        if self.least[at] is None or c < self.least[at]:
            self.least[at] = c
        self.tokens[at] += later
        if lcp >= 0:
            self.tokens[self.stack[lcp]] += base[lcp + 1]
        if more:
            self.more[at] = True
        else:
            self.ends.setdefault(at, []).append(c)
        self.leaves[at] += leaf if leaf is not None else not more and then < len(keys)

    def finish(self) -> None:
        while self.stack:
            self.close(len(self.stack) - 1 <= self.then)

    def rows(self):
        for at, saved, ids, root in self.flushed:
            up = self.parent[at]
            above = self.spans[up] if up >= 0 else False
            known = None if up < 0 or above else self.least[up]
            key, up_key = self.key[at], self.key[up] if above else None
            if not self.spans[at]:
                text = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() if ids else NO_ENDS
                yield (BELOW if above else WHOLE, self.part, None, up_key, self.least[at], self.depth[at], known, self.n[at], self.children[at], self.leaves[at], saved, text, None)
                continue
            sums = (None, self.depth[at], None, 0, self.children[at], 0, 0) if root else (self.least[at], self.depth[at], known, self.n[at], self.children[at], self.leaves[at], saved)
            yield (PART, self.part, key, up_key, *sums, None, None)
            for k in range(0, 0 if root else len(ids), self.chunk):
                yield (ENDS, self.part, key, None, None, None, None, None, None, None, None, ",".join(map(str, ids[k : k + self.chunk])), k // self.chunk)


def _swept(links, segment: int, chunk: int):
    """For mapInArrow over sorted segments."""
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string(), pa.int32()]
    names = [x.split()[0] for x in NODE.split(", ")]

    def run(batches):
        part = TaskContext.get().partitionId()
        sweep = _Sweep(part, *links.value.get(part, (-1, -1)), segment, chunk)
        held = None
        for row in _rows(batches):
            if held:  # a row's leaf needs the LCP with the next
                sweep.add(*held, _common(row[2], held[2]) if (row[1], row[5]) == (held[1], held[5]) else -1)
            held = row
        if held:
            sweep.add(*held, sweep.then)
        sweep.finish()
        out = []
        for row in sweep.rows():
            out.append(row)
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return run


def _hashed_ends(batches):
    """For mapInArrow over packed ids in order: one hash a key, fed row by row."""
    key = state = None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    for row_key, text in _rows(batches):
        if row_key != key:
            if state:
                yield done()
            key, state = row_key, hashlib.sha256(text.encode())
        else:
            state.update(b"," + text.encode())
    if state:
        yield done()


def trie(conversations: DataFrame, segment: int = SEGMENT, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    spark = conversations.sparkSession
    scratch = Scratch(spark, "prefix_trie")
    turns, convs = rebuilt(conversations, scratch)
    rows = with_later(segments(turns, convs, scratch, segment), scratch)
    ranged, links = sort_segments(rows)
    sent = spark.sparkContext.broadcast(links)
    swept = scratch.table(ranged.select("c", "seg", "keys", "chars", "more", "before", "after", "later", "leaf").mapInArrow(_swept(sent, segment, chunk), NODE), "nodes")
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    parts = swept.where(F.col("kind") == PART)
    spanning = parts.groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_conv_id").alias("known"), *(F.sum(s).alias(s) for s in sums))
    spanning = scratch.table(spanning, "spanning")
    least = spanning.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    packed = swept.where(F.col("kind") == ENDS).select("key", "part", "idx", "ends").repartition("key").sortWithinPartitions("key", "part", "idx")
    hashed = packed.select("key", "ends").mapInArrow(_hashed_ends, "key binary, ends_sha256 string")
    whole = swept.where(F.col("kind") == WHOLE).select("conv_id", "depth", "parent_conv_id", *sums, F.col("ends").alias("ends_sha256"))
    # a range knows its own spanning nodes by (range, key), so a node with many children is no hot key
    at_hand = parts.select("part", F.col("key").alias("parent_key")).distinct().join(least, "parent_key")
    below = swept.where(F.col("kind") == BELOW).join(at_hand, ["part", "parent_key"]).select("conv_id", "depth", F.col("above").alias("parent_conv_id"), *sums, F.col("ends").alias("ends_sha256"))
    over = spanning.join(least, "parent_key", "left").join(hashed, "key", "left").select("conv_id", "depth", F.coalesce("above", "known").alias("parent_conv_id"), *sums, F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    return whole.unionByName(below).unionByName(over)
