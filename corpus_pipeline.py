"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import decontaminate, near_dup, queries, rule_ensemble, secrets, sentencepiece_model
from barlake.session import work_dir


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rule ensemble accepts, fitted on `labels` of documents that are present.

    Null and empty texts are scored as empty ones, equal rows go or stay together. Without labels of both kinds all documents
    have one score, so all go or all stay. Columns of any name stay.
    """
    return rule_ensemble.of_quality(docs, queries.table(spark, sf_dir, "labels"), work_dir(spark))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; shingles of five words, 0.8 or more.

    Of ties and repeated rows one stays. Null and empty texts are copies of nothing but of rows with their own doc_id; rows
    without doc_id go only if a row of their group stays. Columns of any name stay.
    """
    return near_dup.without_copies(docs, work_dir(spark), tables=near_dup.Tables(size=5))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark passage; null and empty texts hold none, equal rows go or stay together.

    Columns of any name stay; an empty benchmark leaves all documents.
    """
    return decontaminate.without_leaks(docs, queries.table(spark, sf_dir, "benchmark"), work_dir(spark))


def clean_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text is replaced by the name of its kind, `n_chars` (if there) follows the text; no document goes.

    A null text stays null and has no length; repeated rows stay alike, columns of any name stay.
    """
    cleaned = secrets.without_secrets(docs)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of the whole text, with the outcome of the two checks; a row for each document.

    A null or empty text has no ids; other columns are not read.
    """
    found = sentencepiece_model.tokenize(docs.select("doc_id", "text"), queries.MODEL, into="__tokens")
    return found.select("doc_id", "__tokens.ids", F.size("__tokens.ids").cast("long").alias("n_tokens"), "__tokens.round_trip", "__tokens.parity")


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", no_benchmark),
    ("secret scans", clean_secrets),
    ("SentencePiece encoding and decoding", tokens),
]

#: SQL can't express the stages (trained rules, MinHash, tokens); the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for place, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{place}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
