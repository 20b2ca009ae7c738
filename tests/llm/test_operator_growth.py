"""Steps of operators that must not make more rows than their input holds."""

import re

import numpy as np

from fieldloom.llm import minhash


def test_texts_meet_their_shingles_one_row_a_text(spark):
    """op6: what belongs to a text was joined to each of its shingles' rows; now it is joined once, and shingles follow."""
    sets = [(t, np.array(e, np.uint64).tobytes(), np.ones(len(e), np.int32).tobytes()) for t, e in ((1, range(1, 21)), (2, range(1, 20)), (3, range(100, 120)))]
    sets = spark.createDataFrame([(t, bytearray(e), bytearray(w)) for t, e, w in sets], "t long, elements binary, weights binary")
    members = spark.createDataFrame([(1, 20, 19, True, 1), (2, 19, 19, True, 2), (3, 20, 19, True, 3)], "t long, total long, least long, open boolean, component long")
    found = minhash._partners(sets, members, 0.8)
    assert [(r.x, r.y) for r in found.collect()] == [(1, 2)]
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_frequencies_come_without_a_row_a_shingle(spark):
    """op6: each shingle that texts share was a row of a join with its frequency; now the rarest alone are rows, which meet once."""
    sets, n = [(1, range(0, 100)), (2, range(5, 105)), (3, range(8, 108))], 100
    sets = [(t, np.array(e, np.uint64).tobytes(), np.array([2] + [1] * (n - 1), np.int32).tobytes()) for t, e in sets]
    sets = spark.createDataFrame([(t, bytearray(e), bytearray(w)) for t, e, w in sets], "t long, elements binary, weights binary")
    members = spark.createDataFrame([(1, 101, 101, True, 1), (2, 101, 101, True, 2), (3, 101, 101, False, 3)], "t long, total long, least long, open boolean, component long")
    rows = []
    found = minhash._partners(sets, members, 0.8, 3, lambda df: rows.append(df) or df)
    assert sorted((r.x, r.y) for r in found.collect()) == [(1, 2), (1, 3), (2, 3)]
    # 101 of each, of which 90 have to be shared by two texts of similarity 0.8
    assert rows[0].groupBy("t").count().where("count > 12").isEmpty()
    assert not re.findall(r"Join Inner, \(e#\d+L? = e#\d+L?\)", found._jdf.queryExecution().optimizedPlan().toString())


def test_op10_blocks_are_put_together_in_a_cache():
    """The room of a block's encoding is its output and a few numbers a token at a time, and the bytes are those of one round."""
    import tracemalloc

    import numpy as np

    from fieldloom.llm import token_output as out

    r = np.random.default_rng(3)
    for n in (0, 1, 129, 8191, 8193, 1 << 18):
        ids = np.minimum(r.geometric(0.001, n), 20_000).astype("<u2")
        lengths = out.huffman_lengths(np.bincount(ids, minlength=3))
        codes, sizes = out.canonical_codes(lengths), np.array([n])
        tracemalloc.start()
        payload = out.encode_block(np.arange(1), np.ones(1, bool), sizes, ids, 5, codes, lengths)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 8 * n + (1 << 20)
        if n:
            ends = np.cumsum(lengths[ids].astype(np.int64))
            bits = "".join(f"{int(codes[i]):0{lengths[i]}b}" for i in ids[:5000].tolist())
            at = 24 + 8 + 1 + 4 + 4 * -(-n // out.STRIDE)
            assert "".join(f"{b:08b}" for b in payload[at : at + len(bits) // 8]) == bits[: len(bits) // 8 * 8]
            assert len(payload) == at + 8 * ((int(ends[-1]) >> 6) + 2) + 8
            assert (out.decode_block(payload, out.decode_table(lengths))[4] == ids).all()


def test_op10_ascii_texts_are_cut_as_all_others():
    from tokenizers import Tokenizer

    import numpy as np
    import public_tokenizers
    from fieldloom.llm import tokens

    r = np.random.default_rng(4)
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["".join(map(chr, r.choice([*range(128), *[32, 10, 39, 115, 97, 49] * 40], 60))) for _ in range(3000)]
    library = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
    assert tokens.ByteLevelEncoder(path).encode(texts) == library
    assert [tokens.ASCII.findall(t) for t in texts] == [tokens.BYTE_LEVEL.findall(t) for t in texts]


def test_lm_shard_memory_grows_with_its_trigrams_alone():
    """A shard of many trigrams is worked off in pieces, with the sums of one piece."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from fieldloom.llm import lm

    r, n, kinds = np.random.default_rng(3), 20_000, 5_000
    names = np.sort(r.integers(0, 1 << 63, kinds, np.uint64))
    train = (np.arange(300) % 5 > 0).astype(np.uint8)
    some = lambda top: r.integers(0, top, n).astype(np.uint32)
    blobs = [lm._pack(names, np.full(kinds, 5000, np.uint16), np.sort(some(3)), some(kinds), some(kinds), some(300), train, np.array([300], np.uint32)) for _ in range(30)]
    blobs = pa.array(blobs, pa.binary())
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums, peaks = [], []
    for piece in (1 << 40, 50_000):
        tracemalloc.start()
        sums.append([lm._unpack(b)[0] for b in lm.shard_sums(blobs, none, lambda words: np.zeros(len(words), bool), piece)])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert all((a == b).all() for a, b in zip(*sums))
    assert peaks[1] < 64 * 30 * n < peaks[0]
