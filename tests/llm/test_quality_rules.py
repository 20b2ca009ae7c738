import numpy as np

from fieldloom.llm import quality_rules


def test_wrong_words_are_rejected(spark):
    rng = np.random.default_rng(0)
    common = [f"{a}{b}" for a in "bdfgklmn" for b in "aeiouy"]
    rare = [f"{a}{b}{c}e" for a in "bdfgklmnprst" for b in "aeiouy" for c in "bdfgklmnprst"]
    wrong = [f"{w}{v}" for w, v in zip(rare, rare[7:] + rare[:7])]
    share = 1 / np.arange(1, 49)

    def text(n, others, at=0.3):
        words = np.where(rng.random(n) < at, rng.choice(common, n, p=share / share.sum()), rng.choice(others, n))
        return " ".join(words)

    # right words; none of the common words; one common word over and over
    rows = [(k, text(60 + 15 * k, rare), "xx") for k in range(60)]
    rows += [(100 + k, text(n, wrong, 0), "xx") for k, n in enumerate((150, 300, 800))]
    rows += [(200 + k, " ".join(w for pair in zip(text(100, wrong, 0).split(), ["ba"] * 100) for w in pair), "xx") for k in range(2)]
    got = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(r.base_failed or r.class_distance > 0.3 for r in got.values())
    assert [i for i, r in sorted(got.items()) if not r.kept] == [100, 101, 102, 200, 201]
