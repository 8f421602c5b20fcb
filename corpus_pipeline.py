"""A training corpus from ``documents``: language, near duplicates, benchmark passages, personal data, tokens.

Each stage takes what its predecessor kept and decides on that alone. The first four return the columns of their input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.llm import bpe, decontaminate, langid, minhash, pii
from cellframe.llm.common import small_batches, table
from cellframe.llm.queries import VOCABULARY
from cellframe.spark import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: null texts and texts without a letter go, a missing language is filled in."""
    small_batches(spark)
    return langid.identified(docs, langid.train(docs.select("doc_id", "lang", "text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id."""
    small_batches(spark)
    return minhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked; n_chars follows the text."""
    small_batches(spark)
    masked = docs.withColumn("text", pii.mask(F.col("text")))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    small_batches(spark)
    return bpe.encode(docs, VOCABULARY)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("bpe", tokens),
]

#: Learned, hashed and tokenized stages have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
