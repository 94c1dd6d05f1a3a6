"""Corpus pipeline: toxicity, near duplicates, benchmark leaks, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusionframe.llm.common import drop_between, load, materialize, written
from fusionframe.llm.decontamination import find_leaks
from fusionframe.llm.minhash import first_of_groups
from fusionframe.llm.packing import pack
from fusionframe.llm.pii import TEST_KEY, pseudonymize, session_key
from fusionframe.llm.toxicity import train_and_score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score 0.3 or more."""
    labels = load(spark, sf_dir, "labels").select("doc_id", "toxic")
    return train_and_score(docs, docs, labels).where("score < 0.3").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first row of each group of near copies: five-word shingles, similarity 0.8 or more."""
    rows = materialize(docs.select(*COLUMNS).withColumn("uid", F.monotonically_increasing_id()), "rows")
    return rows.join(first_of_groups(rows), "uid", "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return find_leaks(docs.select(*COLUMNS), load(spark, sf_dir, "benchmark")).where("size(leaked_items) = 0").select(*COLUMNS)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal numbers, dates and addresses; n_chars follows the new text.

    The secret is spark.fusionframe.pseudonymKey; on test tables, where it is unset, a published key.
    """
    return pseudonymize(docs, session_key(spark, TEST_KEY)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 tokens."""
    return pack(docs.select("doc_id", "text", "source"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("private_data", private_data), ("packing", packing)]

#: The trained scores and fingerprints are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        mark = written()
        docs = materialize(stage(spark, docs, sf_dir), name)
        drop_between(spark, mark, written() - 1)  # what the stage wrote on its way
    return docs
