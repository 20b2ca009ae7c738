"""Sharding: k-d tree over metadata, split at distributed weighted medians along the widest dimension.

Every dimension is a function of the text (sizes, line count, share of bytes beyond ASCII, checksum), so that
equal texts have equal coordinates and can never be parted; a jitter from the text's hash breaks ties between
different texts. Each level needs one aggregate for the nodes' boxes and a few histogram passes that narrow the
weighted medians of all nodes together; the driver sees at most nodes x bins rows, however large the input.

Defined results: a null text has size 1 and checksum 0; repeated rows share a shard and get slots of their own;
an empty table gives no rows; further columns are ignored. Law: ``bytes``, sizes as near equal as whole groups of
equal texts allow: copies of one text that outweigh an equal share are a shard alone, and the tree parts all other
rows into the shards that are left. There are fewer than ``n_shards`` only where there are fewer different texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, dense_rank_rows

BINS = 1024
PASSES = 3


def metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.col(text_col)
    jitter = F.shiftrightunsigned(F.xxhash64(text), 12) / float(1 << 52)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), jitter.alias("jitter"), F.coalesce(F.length(text), F.lit(0)).alias("chars"), F.coalesce(F.length(text) - F.length(F.translate(text, "\n", "")), F.lit(0)).alias("lines"))
    return rows.select(
        "doc_id", "size", "text_crc32",
        F.log2(F.col("size") + F.col("jitter")).alias("d_size"),
        F.log2(F.lit(1.0) + F.col("lines") + F.col("jitter")).alias("d_lines"),
        (F.lit(10.0) * (F.col("size") - 1 - F.col("chars") + F.col("jitter")) / F.col("size")).alias("d_far"),
        (F.col("text_crc32") / float(1 << 30) + F.col("jitter") / 1024).alias("d_hash"),
    )


def _leaf(splits: dict[int, tuple[str, float]], node: int) -> Column:
    """The node that a row falls to: children of n are 2n and 2n + 1."""
    if node not in splits:
        return F.lit(node)
    dim, cut = splits[node]
    return F.when(F.col(dim) < F.lit(cut), _leaf(splits, 2 * node)).otherwise(_leaf(splits, 2 * node + 1))


def _wants(totals: dict[int, int], fixed: int, leaves: int) -> dict[int, int]:
    """Leaves that each node is to have: one each, then always one more to the largest by leaf; ``fixed`` have one."""
    wants = dict.fromkeys(totals, 1)
    for _ in range(leaves - fixed - len(totals) if totals else 0):
        wants[max(totals, key=lambda n: (totals[n] / (wants[n] + 1), n))] += 1
    return wants


def kd_splits(rows: DataFrame, dims: list[str], target_bytes: float | None = None, leaves: int | None = None) -> dict[int, tuple[str, float]]:
    """Splits by node number (root 1), until there are ``leaves`` of them or all hold at most ``target_bytes``."""
    splits: dict[int, tuple[str, float]] = {}
    while True:
        box = [f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]
        nodes = rows.groupBy(_leaf(splits, 1).alias("node")).agg(F.sum("size").alias("total"), *box).collect()  # one row a leaf
        open_nodes, totals = {}, {}
        for n in nodes:
            dim = max(dims, key=lambda d: n[f"hi_{d}"] - n[f"lo_{d}"])
            if n[f"hi_{dim}"] > n[f"lo_{dim}"]:
                open_nodes[n.node] = [dim, n[f"lo_{dim}"], n[f"hi_{dim}"], 0.0, n.total / 2]
                totals[n.node] = n.total
        if leaves is not None:
            wants = _wants(totals, len(nodes) - len(totals), leaves)
            for node, want in wants.items():
                open_nodes[node][4] = totals[node] * (want // 2) / want
            open_nodes = {node: state for node, state in open_nodes.items() if wants[node] > 1}
        else:
            open_nodes = {node: state for node, state in open_nodes.items() if totals[node] > target_bytes}
        if not open_nodes:
            return splits
        for _ in range(PASSES):
            slot = F.lit(None).cast("int")
            for node, (dim, lo, hi, _, _) in open_nodes.items():
                width = (hi - lo) / BINS
                if width > 0:
                    at = F.floor((F.col(dim) - F.lit(lo)) / F.lit(width)).cast("int")
                    slot = F.when((F.col("node") == node) & (F.col(dim) >= F.lit(lo)) & (F.col(dim) <= F.lit(hi)), F.least(F.greatest(at, F.lit(0)), F.lit(BINS - 1))).otherwise(slot)
            hist = rows.withColumn("node", _leaf(splits, 1)).withColumn("bin", slot).where("bin is not null")
            got: dict[int, dict[int, int]] = {}
            for r in hist.groupBy("node", "bin").agg(F.sum("size").alias("b")).collect():  # at most leaves x BINS rows
                got.setdefault(r.node, {})[r.bin] = r.b
            for node, state in open_nodes.items():
                dim, lo, hi, below, half = state
                width = (hi - lo) / BINS
                for b in sorted(got.get(node, {})):
                    if below + got[node][b] >= half:
                        state[1:4] = [lo + b * width, lo + (b + 1) * width, below]
                        break
                    below += got[node][b]
                state[4] = half
        for node, (dim, lo, hi, below, half) in open_nodes.items():
            inside = got.get(node, {}).values()
            splits[node] = (dim, hi if half - below > sum(inside) / 2 else lo)


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for all rows."""
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.table(metadata(docs, id_col, text_col), "metadata")
    dims = [c for c in rows.columns if c.startswith("d_")]
    # copies of one text that outweigh an equal share of what is left; at most n_shards rows
    groups = rows.groupBy(*dims).agg(F.sum("size").alias("bytes")).orderBy(F.desc("bytes"), *dims).limit(n_shards).collect()
    rest, heavy = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], []
    for g in groups:
        if len(heavy) == n_shards - 1 or g["bytes"] * (n_shards - len(heavy)) <= rest:
            break
        heavy.append(g)
        rest -= g["bytes"]
    alone = F.lit(None).cast("int")
    for k, g in enumerate(heavy):
        same = F.lit(True)
        for d in dims:
            same = same & (F.col(d) == F.lit(g[d]))
        alone = F.when(same, k).otherwise(alone)
    splits = kd_splits(rows.where(alone.isNull()), dims, leaves=n_shards - len(heavy))
    order = []

    def walk(node: int) -> None:
        if node in splits:
            walk(2 * node)
            walk(2 * node + 1)
        else:
            order.append(node)

    if rest:
        walk(1)
    leaf = _leaf(splits, 1)
    number = F.lit(0)
    for k, node in enumerate(order):
        number = F.when(leaf == node, k).otherwise(number)
    placed = rows.select("doc_id", "size", "text_crc32", F.coalesce(alone + len(order), number).cast("int").alias("shard"))
    ranked = dense_rank_rows(placed, "shard", [F.col("doc_id"), F.col("text_crc32")], rows.count(), [F.col("doc_id"), F.col("text_crc32")], "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
