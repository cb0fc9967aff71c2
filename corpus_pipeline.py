"""The corpus pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its
result is written as Parquet and read again. All but the last return the columns of
documents: languages that nobody could name go, one document of each group of near
duplicates stays, passages that repeat an earlier document are cut out, secrets are
masked, and what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.llm import language_id, minhash_forest, packing, passages, secret_scan
from strataform.llm.common import Tables


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those of ``und`` (null text, no letter) go."""
    model = language_id.learn(docs.where(~language_id.held_out()))
    return language_id.labelled(docs, model).where(F.col("lang_pred") != language_id.UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component; null doc_ids stay."""
    gone = minhash_forest.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; a document of which nothing is left goes."""
    return passages.without_passages(docs, passages.passages(docs)).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked."""
    return secret_scan.masked(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: its sequence and its place there."""
    return packing.packed(docs)


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("secret_scan", secrets),
    ("best_fit_packing", packed),
]

#: SQL can't express these stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables, before = Tables(spark, "pipeline"), ()
    for name, stage in STAGES[:-1]:
        docs = tables.saved(stage(spark, docs, sf_dir), name, before)  # the table of the stage before goes
        before = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)
