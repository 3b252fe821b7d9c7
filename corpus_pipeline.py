"""The corpus pipeline: toxicity, quality, near duplicates, PII, packing; each stage is written as Parquet and read by the next.

Stages take and return the columns of documents; further columns of their input,
whatever their names, are left out. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import best_fit, bradley_terry, ftrl, parity_join, surrogates
from tessera.llm.common import crc_part, materialize, small_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The key of the surrogates; a deployment sets its own.
KEY = b"tessera-demonstration-key"
#: Toxic from this score on; good from bradley_terry.CUT on.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from whole texts of the documents table.

    Null and empty texts have the score of the intercept, so they stay unless most
    labelled documents are toxic; repeated rows are judged alike.
    """
    weights = ftrl.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_part("doc_id", 5) != 0)
    return ftrl.score(docs.select(*COLUMNS), weights).filter(F.col("score") < TOXIC).select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the quality cut go; the ranking learns from whole texts of the documents table.

    Null texts are judged as empty ones; repeated rows are judged alike.
    """
    ranking = bradley_terry.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_part("doc_id", 4) != 2)
    return bradley_terry.score(docs.select(*COLUMNS), ranking).filter(F.col("score") >= bradley_terry.CUT).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id: five-word shingles, Jaccard similarity 0.8 or more.

    Documents with null or empty texts, or without an id, are copies of nothing
    and stay. Rows of a repeated id stay or go together: they go if every one of
    them is a copy of a document with a smaller id.
    """
    groups = parity_join.jaccard_components(docs, width=5, num=80, den=100)
    copies = groups.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("copy")).filter("copy").select("doc_id")
    return docs.select(*COLUMNS).join(copies, "doc_id", "left_anti").select(*COLUMNS)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by surrogates; n_chars follows the new text. Null texts and their null n_chars stay."""
    done = surrogates.pseudonymize(docs.select(*COLUMNS), KEY)
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places in training sequences: doc_id, piece, n_words, bin_id, start. Documents without words have one piece without a bin."""
    return best_fit.pack(docs)


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("near copies", drop_near_copies), ("pii", replace_pii), ("packing", pack)]

#: Trained scores and components are not expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
