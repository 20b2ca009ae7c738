"""A training corpus from raw documents: rules, classifier, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and is written as Parquet in
the shared folder and read again. All but the last return the columns of documents. Rules and near-duplicates number
their rows once and go by these numbers, the others pass rows on, so that null and repeated ids neither lose a row nor
lend one row the verdict of another.

Defined results: a null text is empty: the rules reject it; other null columns are passed on; of repeated rows one stays;
an empty table stays empty; further columns end at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import minhash, packing, quality_classifier, quality_rules, suffix_dedup
from fieldloom.llm.common import Scratch, documents
from fieldloom.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Passages of over 50 words are to go: bytes that 51 words with their spaces have at least, at four letters and more a word.
PASSAGE_BYTES = 250


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of documents and ``row``, a number made once: the table is written and read again."""
    return Scratch(spark, "rows").table(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")


def _without(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows that are not rejected; there are fewer of those that are."""
    gone = verdicts.where("not kept").select(F.col("doc_id").alias("row"))
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(spark, docs)
    return _without(rows, quality_rules.judged(rows, id_col="row"))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    carried = [c for c in COLUMNS if c != "doc_id"]
    return quality_classifier.classify(docs.select(*COLUMNS), labels, carry=tuple(carried)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class, also where all its rows have one id."""
    rows = _numbered(spark, docs)
    return _without(rows, minhash.near_duplicates(rows, 0.8, id_col="row"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = suffix_dedup.dedup(docs.select(*COLUMNS), PASSAGE_BYTES, carry=("lang", "source"))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=1, seq_len=2048)


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("minhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
