"""Quality rules: divergence of a text's histograms from its language's, by Jensen-Shannon distance.

1. Base counts (words, symbols, repeated lines and 5-word windows) are built-in array functions of each row.
2. Two histograms, over classes of characters and over the language's commonest words (and one cell for all
   other words), are compared with references summed over all documents of the language.
3. A text fails if a distance is beyond its limit; texts below the minimum lengths are not judged by it. The limit of
   the word distance falls with a text's length, as a short text is far from its language by chance: all texts without
   a common word are only about 0.41 away, since most of a language's words fall in the cell of all others.

The reference is one row a language with a fixed number of cells; word counts are summed before any shuffle.

Defined results: a null text has no words and fails the base rules; a null language is a language of its own;
repeated rows get equal verdicts; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: White space between words (fixed values): space and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
JAVA_WS = " \\t\\n\\x0B\\f\\r"
SYMBOLS = "#*$%&|<>"
#: Classes of characters by the code points they hold; the last cell takes all others.
CLASSES = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "stop": ".,;:!?'\"()-", "symbol": SYMBOLS + "@=+_/\\~^`{}[]", "space": WS}
COMMON = 48


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{JAVA_WS}]+"), "")


def _covered(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more. The columns below are named, so that none is made anew."""
    twice = F.transform(hashes, lambda s, k: F.when((s["h"] == F.get(hashes, k - 1)["h"]) | (s["h"] == F.get(hashes, k + 1)["h"]), s["i"]))
    return F.aggregate(
        F.sort_array(F.filter(twice, lambda i: i.isNotNull())),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, i: F.struct((i + 5).alias("end"), (acc["n"] + i + 5 - F.greatest(acc["end"], i)).alias("n")),
        lambda acc: acc["n"],
    )


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each row. Windows are told apart by a 64-bit hash of their words' hashes. Small letters, then white
    space, are taken off first, so that the other classes are counted in the few characters that are left."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), text.alias("text"), F.xxhash64(text).alias("key"))
    df = df.withColumn("no_small", F.regexp_replace("text", "[a-z]+", ""))
    df = df.withColumn("rest", F.regexp_replace("no_small", f"[{JAVA_WS}]+", ""))
    df = df.withColumn("words", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(WS)) != ""))
    n, small, space = F.size("words"), F.length("text") - F.length("no_small"), F.length("no_small") - F.length("rest")
    classes = [{"lower": small, "space": space}.get(name, _without(F.col("rest"), chars)).cast("double") for name, chars in CLASSES.items()]
    df = df.select(
        "doc_id", "key", "lang", "words",
        n.cast("long").alias("n_words"),
        (F.length("text") - space).cast("long").alias("word_chars"),
        _without(F.col("rest"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length("text").cast("double").alias("chars"),
        F.array(*classes).alias("classes"),
    )
    window = F.transform("words", lambda w, i: F.xxhash64(w, *(F.get("words", i + k) for k in range(1, 5))))
    df = df.withColumn("hashes", F.slice(window, F.lit(1), F.greatest(n - 4, F.lit(0)))).drop("words")
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))
    df = df.withColumn("placed", F.when(F.size("hashes") > F.size(F.array_distinct("hashes")), placed)).drop("hashes")
    return df.withColumn("n_repeat_words", F.coalesce(_covered(F.col("placed")), F.lit(0)).cast("long")).drop("placed")


def _half_kl(p: Column, q: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / ((p + q) / 2))).otherwise(0.0) / 2


def judged(docs: DataFrame, max_class_distance: float = 0.3, max_word_distance: float = 0.44, long_word_distance: float = 0.33, word_noise: float = 6.0, min_chars: int = 200, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, class_distance, word_distance, base_failed and kept for every row.

    The limit of a text of n words is sqrt(long_word_distance ** 2 + word_noise / n), max_word_distance at most.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality_rules")
    base = scratch.table(base_counts(docs, id_col, text_col), "base")
    n = len(CLASSES)
    cells = lambda c, total: F.concat(c, F.array(total - F.aggregate(c, F.lit(0.0), lambda a, b: a + b)))
    shares = [(F.sum(F.col("classes")[k]) / F.sum("chars")).alias(f"c{k}") for k in range(n)]
    ref_c = base.groupBy("lang").agg(F.sum("chars").alias("all_chars"), *shares).select("lang", cells(F.array(*(f"c{k}" for k in range(n))), F.lit(1.0)).alias("ref_classes"))
    words = docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.explode(words_of(F.lower(F.col(text_col)))).alias("word"))
    counts = scratch.table(words.groupBy("lang", "word").count(), "word_counts")
    totals = counts.groupBy("lang").agg(F.sum("count").alias("all_words"))
    # the commonest of each language: of each hashed share of its words first, so that no task sorts a whole vocabulary
    first = counts.withColumn("__s", F.pmod(F.xxhash64("word"), F.lit(512)))
    first = first.withColumn("__r", F.row_number().over(Window.partitionBy("lang", "__s").orderBy(F.desc("count"), "word"))).where(F.col("__r") <= COMMON)
    top = first.withColumn("__r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))).where(F.col("__r") <= COMMON)
    top = scratch.table(top.join(totals, "lang").select("lang", "word", (F.col("count") / F.col("all_words")).alias("q")), "common")
    # distance over the common cells that a text has; those that it lacks give half of their own share. Copies of a
    # text are counted together, and so is their number of words
    per_cell = words.join(top, ["lang", "word"]).groupBy("key", "lang", "word", "q").agg(F.count("*").cast("double").alias("n"))
    per_text = per_cell.groupBy("key", "lang").agg(F.collect_list(F.struct("n", "q")).alias("cells"), F.sum("q").alias("seen"), F.sum("n").alias("common"))
    all_q = top.groupBy("lang").agg(F.sum("q").alias("all_q"))
    lengths = base.where("n_words > 0").groupBy("key", "lang").agg(F.sum("n_words").cast("double").alias("m"))
    sides = lengths.join(per_text, ["key", "lang"], "left").join(all_q, "lang")
    rest = F.greatest(F.lit(0.0), 1 - F.col("all_q"))
    js = lambda p, q: _half_kl(p, q) + _half_kl(q, p)
    known = F.coalesce(F.aggregate("cells", F.lit(0.0), lambda a, c: a + js(c["n"] / F.col("m"), c["q"])), F.lit(0.0))
    other = js(1 - F.coalesce("common", F.lit(0.0)) / F.col("m"), rest)
    lacking = (F.col("all_q") - F.coalesce("seen", F.lit(0.0))) / 2
    word_d = sides.select("key", "lang", F.sqrt(F.greatest(F.lit(0.0), known + lacking + other)).alias("word_distance"))
    mine = F.transform(cells(F.col("classes"), F.col("chars")), lambda c: c / F.col("chars"))
    class_d = F.aggregate(F.zip_with(mine, F.col("ref_classes"), js), F.lit(0.0), lambda a, b: a + b)
    refs = scratch.table(ref_c, "classes")
    out = base.join(refs, "lang").join(word_d, ["key", "lang"], "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far_c = (F.col("chars") >= min_chars) & (F.col("class_distance") > max_class_distance)
    limit_w = F.least(F.lit(max_word_distance), F.sqrt(F.lit(long_word_distance**2) + word_noise / F.col("n_words")))
    far_w = (F.col("n_words") >= min_words) & (F.col("word_distance") > limit_w)
    return (
        out.withColumn("class_distance", F.when(F.col("chars") > 0, F.sqrt(F.greatest(F.lit(0.0), class_d))))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & ~F.coalesce(far_c, F.lit(False)) & ~F.coalesce(far_w, F.lit(False)))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
    )
