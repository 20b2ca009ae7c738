"""Token-ID / binary output: canonical length-limited Huffman coding of token ids.

``encode_documents`` tokenizes whole texts in ascending id order, ``huffman_lengths`` turns the global counts
into a length-limited canonical code (package-merge), ``write_dataset`` writes self-contained blocks, and
``read_dataset`` decodes them by table.

File format (a folder): ``codebook/`` holds one row (version, n_symbols, code lengths as uint8); ``blocks/``
holds rows (first_doc, payload). A payload is little-endian::

    b"FLH2" | n_docs u32 | n_tokens u32 | n_points u32 | first_token u64
    doc_id i64 * n_docs | one bit a document, 0 where its id is null | tokens of each document u32 * n_docs
    bit offset of each STRIDE-th token u32 * n_points | big-endian bit stream, padded by 8 zero bytes

A block decodes without its neighbours; its checkpoints let a reader enter at any STRIDE-th token, and let
the table-driven decoder run all strides of a block side by side.

Defined results: a null text counts as empty and has only the end id; a null id comes before all others and stays null;
repeated rows and tied ids are kept, ties in the order of a hash of their text; an empty table gives empty files;
further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, parts_for
from .tokens import encoder, in_batches

MAGIC, HEAD = b"FLH2", "<4sIIIQ"
#: Longest code, tokens between bit-offset checkpoints, tokens of a block at least (the last of a batch has fewer).
MAX_BITS, STRIDE, BLOCK = 16, 128, 1 << 19
#: Tokens that are put into words together, a multiple of STRIDE: their numbers stay in a core's cache.
TOGETHER = 1 << 13
#: Text that one task encodes, about.
PART_BYTES = 64 << 20


def huffman_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Code lengths (0: unused) of an optimal prefix code with no code over ``limit`` bits, by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    rounds, packed = [], np.empty(0)
    for _ in range(limit):
        merged = np.concatenate([leaf, packed])
        by = np.argsort(merged, kind="stable")
        rounds.append(by)
        merged = merged[by]
        packed = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take, depth = 2 * len(leaf) - 2, np.zeros(len(leaf), np.int64)
    for by in reversed(rounds):  # of each round's first items, leaves gain a bit and packages open in the round before
        chosen = by[:take]
        leaves = chosen[chosen < len(leaf)]
        depth[leaves] += 1
        take = 2 * (len(chosen) - len(leaves))
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint64)
    code = before = 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for s in order[np.searchsorted(lengths[order], 1) :]:
        code <<= int(lengths[s]) - before
        codes[s], before = code, int(lengths[s])
        code += 1
    return codes


def decode_table(lengths: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """For each value of the next ``bits`` bits: the symbol and the bits it takes."""
    symbols, used = np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.uint8)
    codes = canonical_codes(lengths)
    order = np.lexsort((codes, lengths))
    order = order[np.searchsorted(lengths[order], 1) :]
    span = (1 << (bits - lengths[order].astype(np.int64)))
    filled = int(span.sum())
    symbols[:filled], used[:filled] = np.repeat(order, span), np.repeat(lengths[order], span)
    return symbols, used


def encode_block(doc_ids: np.ndarray, known: np.ndarray, doc_tokens: np.ndarray, ids: np.ndarray, first_token: int, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    width, words = lengths.astype(np.int64), np.zeros((len(ids) * MAX_BITS >> 6) + 2, np.uint64)
    points, done = [np.empty(0, "<u4")], 0
    for begin in range(0, len(ids), TOGETHER):
        some = ids[begin : begin + TOGETHER]
        size = width[some]
        at = np.cumsum(size)
        end = done + int(at[-1])
        at += done - size
        done = end
        word, shift = at >> 6, 64 - (at & 63) - size
        value = codes[some]
        over = np.flatnonzero(shift < 0)
        kept = value << np.maximum(shift, 0).view(np.uint64)
        kept[over] = value[over] >> (-shift[over]).view(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] |= np.bitwise_or.reduceat(kept, first)
        words[word[over] + 1] |= value[over] << (64 + shift[over]).view(np.uint64)
        points.append(at[::STRIDE].astype("<u4"))
    points, words = np.concatenate(points), words[: (done >> 6) + 2 if len(ids) else 1]
    head = struct.pack(HEAD, MAGIC, len(doc_ids), len(ids), len(points), first_token)
    return head + doc_ids.astype("<i8").tobytes() + np.packbits(known).tobytes() + doc_tokens.astype("<u4").tobytes() + points.tobytes() + words.astype(">u8").tobytes() + bytes(8)


def decode_block(payload: bytes, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
    """(doc_ids, whether each is known, tokens of each, first token's place among all, ids)."""
    magic, docs, n, n_points, first = struct.unpack_from(HEAD, payload)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    at = struct.calcsize(HEAD)
    doc_ids = np.frombuffer(payload, "<i8", docs, at)
    known = np.unpackbits(np.frombuffer(payload, np.uint8, -(-docs // 8), at := at + 8 * docs), count=docs).astype(bool)
    doc_tokens = np.frombuffer(payload, "<u4", docs, at := at + -(-docs // 8))
    points = np.frombuffer(payload, "<u4", n_points, at := at + 4 * docs)
    raw = np.frombuffer(payload, np.uint8, offset=at + 4 * n_points).astype(np.uint32)
    window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    symbols, used = table
    out, pos = np.empty((STRIDE, n_points), np.uint32), points.astype(np.int64)
    last = len(window) - 1
    for k in range(min(STRIDE, n)):
        if k and (k - 1) * 1 + (n_points - 1) * STRIDE >= n - 1:
            np.minimum(pos, last << 3, out=pos)  # the last stride may have ended
        code = (window[pos >> 3] >> (8 - (pos & 7)).astype(np.uint32)) & 0xFFFF
        out[k] = symbols[code]
        pos += used[code]
    return doc_ids, known, doc_tokens, first, out.T.reshape(-1)[:n]


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", n_parts: int = 0) -> DataFrame:
    """(doc_id, part, before, n_tokens, ids, counts): whole texts in ascending id order, range-dealt over parts.

    ``before``: tokens of the part's earlier documents; ``ids``: little-endian, uint16 if the vocabulary allows;
    ``counts``: at the first row of each batch, the ids that occur in it, and how often (uint32 each); else null.
    """
    dtype = "<u2" if _vocabulary(tokenizer) <= 1 << 16 else "<u4"
    end = np.array([end_id], dtype).tobytes()

    def run(batches):
        from pyspark import TaskContext

        own, part, before = encoder(tokenizer, dtype), TaskContext.get().partitionId(), 0
        width = np.dtype(dtype).itemsize
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = []
            for a, b in in_batches(texts, 256, 1 << 20):
                ids += [x + end for x in own.encode(texts[a:b])]
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // width
            ends = before + np.cumsum(n)
            seen = np.bincount(np.frombuffer(b"".join(ids), dtype))
            used = np.flatnonzero(seen)
            counts = [np.concatenate([used, seen[used]]).astype("<u4").tobytes()] + [None] * (len(ids) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(ids), part), pa.int32()), pa.array(ends - n), pa.array(n), pa.array(ids, pa.binary()), pa.array(counts[: len(ids)], pa.binary())],
                names=["doc_id", "part", "before", "n_tokens", "ids", "counts"],
            )
            before = int(ends[-1]) if len(ids) else before
        own.memo.clear()

    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text)
    if not n_parts:
        n_bytes = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
        n_parts = parts_for(docs.sparkSession, n_bytes, PART_BYTES)
    # rows of one id are split by their texts' hash and a number of their own
    order = ["doc_id", F.xxhash64("text"), "row"]
    rows = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(n_parts, *order).sortWithinPartitions(*order).drop("row")
    return rows.mapInArrow(run, "doc_id long, part int, before long, n_tokens long, ids binary, counts binary")


def _vocabulary(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()


def global_counts(encoded: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents; the driver gets one row for each id of the vocabulary at most."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                used, n = np.frombuffer(blob, "<u4").reshape(2, -1).astype(np.int64)
                if len(used) and used[-1] >= len(total):
                    total = np.append(total, np.zeros(int(used[-1]) + 1 - len(total), np.int64))
                total[used] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = encoded.where("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def write_dataset(encoded: DataFrame, dtype: str, path: str, block: int = BLOCK) -> None:
    """Writes the file format to the folder ``path`` through Spark, so that any store will do."""
    spark = encoded.sparkSession
    lengths = huffman_lengths(global_counts(encoded))
    codes = canonical_codes(lengths)
    totals = sorted(encoded.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts = dict(zip((r.part for r in totals), np.cumsum([0] + [r.n for r in totals]).tolist()))

    def run(batches):
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            doc_ids, part, before, n = (batch.column(k).fill_null(0).to_numpy(zero_copy_only=False) for k in range(4))
            ends = np.cumsum(n)
            cut = 0
            while cut < len(doc_ids):
                base = int(ends[cut - 1]) if cut else 0
                to = max(cut + 1, int(np.searchsorted(ends, base + block, "right")))
                to = min(to, cut + int(np.argmax(np.append(part[cut:], -1) != part[cut])))
                ids = np.frombuffer(b"".join(batch.column(4).slice(cut, to - cut).to_pylist()), dtype)
                first = starts[int(part[cut])] + int(before[cut])
                blob = encode_block(doc_ids[cut:to], known[cut:to], n[cut:to], ids, first, codes, lengths)
                yield pa.RecordBatch.from_arrays([pa.array([first]), batch.column(0).slice(cut, 1), pa.array([blob], pa.binary())], names=["first_token", "first_doc", "payload"])
                cut = to

    blocks = encoded.select("doc_id", "part", "before", "n_tokens", "ids").mapInArrow(run, "first_token long, first_doc long, payload binary")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(1, len(lengths), bytearray(lengths.tobytes()))], "version int, n_symbols int, lengths binary").coalesce(1).write.parquet(f"{path}/codebook")


def read_dataset(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/codebook").first().lengths, np.uint8)  # one entry an id
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    table = decode_table(lengths)

    def run(batches):
        for batch in batches:
            for payload in batch.column(0):
                doc_ids, known, n, first, ids = decode_block(payload.as_py(), table)
                n = n.astype(np.int64)
                ends = np.cumsum(n)
                starts = ends - n
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                out = [pa.array(doc_ids, mask=~known), pa.array(first + starts), pa.array(n), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return spark.read.parquet(f"{path}/blocks").select("payload").mapInArrow(run, schema)


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, writes and reads back; the files lie in the shared folder."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "token_output")
    dtype = "<u2" if _vocabulary(tokenizer) <= 1 << 16 else "<u4"
    encoded = scratch.table(encode_documents(docs, tokenizer, end_id, id_col, text_col), "encoded")
    write_dataset(encoded, dtype, scratch.path("files"))
    scratch.drop(encoded)
    return read_dataset(spark, scratch.path("files"))
