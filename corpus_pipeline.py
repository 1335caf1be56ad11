"""The corpus pipeline: language ID, quality classifier, one document of each group of near copies, secrets masked,
and packing into training sequences.

Every stage is a function (spark, docs, sf_dir) over all its predecessor kept; all but the last return the columns of
documents. `run` writes each stage's rows as Parquet in the shared folder and gives them to the next, so a lost
executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyhound.llm import op1_jaccard_join, op2_secrets, op5_language, op9_packing, op10_line_crf
from copyhound.llm.shared import documents, stored
from copyhound.llm.tokens import vocabulary_path
from copyhound.sources.tables import read_table

LEAST_LANGUAGE_SCORE = 0.5
#: No SQL: the stages learn models and use tokenizers; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no known language: a null text or no letters (`und`), or a posterior below
    LEAST_LANGUAGE_SCORE. The model learns from the labelled documents that the stage gets; lang stays as it was."""
    model = op5_language.train(docs)
    if not model.languages:
        return docs.where(F.lit(False))
    marked = op5_language.predict(docs, model)
    good = (F.col("lang_pred") != op5_language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return marked.where(good).select(docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the line chain scores below its threshold; it learns from `labels`."""
    chain = op10_line_crf.train(docs, read_table(spark, sf_dir, "labels"))
    return op10_line_crf.classify(docs, chain).where("predicted = 1").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that n-gram Jaccard links connect (five words, 0.8): that of the smallest
    doc_id, and of texts with equal doc_ids the one of the least hash. Wordless texts are in no group and all stay."""
    groups = op1_jaccard_join.jaccard_groups(docs, k=5, percent=80).where("group is not null")
    first = groups.groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash")).distinct()
    has_word = F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.xxhash64("text") == F.col("first_hash"))
    kept = docs.where(has_word).join(first, same).dropDuplicates(["first_id", "first_hash"])
    return kept.select(docs.columns).union(docs.where(~has_word))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found by [SECRET]; keeps all documents."""
    return op2_secrets.redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the documents into sequences of power-of-two length, one row for each."""
    return op9_packing.pack(docs, vocabulary_path(), as_loaded=True)


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", mask_secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
