import hashlib

from fieldloom.llm import lm, minhash, suffix_dedup


def _text(k, n=150):
    return " ".join(f"w{k}x{i}" for i in range(n))


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_suffix_dedup_searches_texts_of_null_and_shared_ids(spark):
    shared = _text(0)
    rows = [(None, "a " + shared), (7, "b " + shared), (7, "c " + _text(1)), (None, "d " + _text(1)), (7, _text(2))]
    got = suffix_dedup.dedup(_docs(spark, rows), 400).collect()
    left = sorted((r.doc_id or 0, r.kept_sha256) for r in got)
    want = [(None, "a"), (7, "b"), (7, "c"), (None, "d"), (7, _text(2))]
    assert left == sorted((i or 0, hashlib.sha256(t.encode()).hexdigest()) for i, t in want)


def test_minhash_parts_texts_of_one_id(spark):
    rows = [(7, _text(1)), (7, _text(2)), (7, _text(2)), (8, _text(2)), (None, _text(3)), (None, _text(3)), (9, _text(3, 149)), (None, _text(4)), (None, None)]
    got = minhash.near_duplicates(_docs(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == 5
    assert len({r.component_id for r in got}) == 5 and {r.component_id for r in got if r.kept and r.component_id >= 0} == {7, 9}
    assert sum(r.kept for r in got if r.doc_id == 7) == 2 and [r.kept for r in got if r.doc_id == 9] == [True]


def test_lm_scores_null_ids(spark):
    rows = [(1, "a b a b"), (None, "a b c"), (None, "a"), (0, "b b"), (0, "a")]
    got = lm.score(_docs(spark, rows)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in got) == [(-1, 2), (-1, 4), (0, 2), (0, 3), (1, 5)]
    assert not any(r.held_out for r in got if r.doc_id is None)
