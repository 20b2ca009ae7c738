import collections

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _text(k, n=150):
    return " ".join(f"w{k}x{i}" for i in range(n))


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def test_repeated_row_outlives_stages_3_and_4(spark):
    docs = _docs(spark, [(1, _text(1)), (1, _text(1)), (2, _text(2)), (3, _text(2)), (4, _text(4))])
    third = pipeline.near_duplicates(spark, docs, "").cache()
    assert collections.Counter(r.text for r in third.collect()) == {_text(k): 1 for k in (1, 2, 4)}
    fourth = pipeline.repeated_passages(spark, third, "")
    assert sorted(r.text for r in fourth.collect()) == sorted(_text(k) for k in (1, 2, 4))


def test_null_and_shared_ids_keep_their_rows(spark):
    rows = [(None, _text(1)), (None, _text(2)), (7, _text(3)), (7, _text(4)), (8, _text(5))]
    want = sorted(((i or 0, t) for i, t in rows), key=str)
    third = pipeline.near_duplicates(spark, _docs(spark, rows), "").cache()
    assert sorted(((r.doc_id or 0, r.text) for r in third.collect()), key=str) == want
    fourth = pipeline.repeated_passages(spark, third, "")
    assert sorted(((r.doc_id or 0, r.text) for r in fourth.collect()), key=str) == want
    # one of two texts with one id fails the rules, the other stays
    judged = pipeline.rules(spark, _docs(spark, [(7, _text(3)), (7, "a b"), (None, _text(4))]), "")
    assert {(r.doc_id, r.text) for r in judged.collect()} == {(7, _text(3)), (None, _text(4))}
