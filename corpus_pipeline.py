"""A document pipeline: language, quality, near duplicates, personal data, packing.

Each stage works on all that its predecessor kept; between stages the documents are
written as Parquet and read again. Stages decide rows by their texts, never by their ids:
null ids, ids that several rows share and repeated rows are kept or dropped as they merit.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, langid, packing, private, quality
from tidemark.llm.queries import fold, quality_labels
from tidemark.session import stage


#: Rows of an Arrow batch. Texts are long: the default of 10,000 rows holds tens of megabytes, several times over in every worker.
BATCH_ROWS = 1024


def _bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letters, or less than half of them in spans of one language."""
    _bounded_batches(spark)
    return langid.keep_identified(docs, fold(4) != 2, 0.5)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of good quality is below 0.3."""
    _bounded_batches(spark)
    return quality.keep_good(docs, quality_labels(spark, sf_dir), 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group linked by three quarters of their shingles: that of the smallest id, null ids last."""
    _bounded_batches(spark)
    return jaccard.keep_one(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and terms that disclose it; ``n_chars`` follows the text."""
    _bounded_batches(spark)
    clean = private.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, with their places in training sequences."""
    _bounded_batches(spark)
    return packing.pack(packing.cut(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("near duplicates", drop_near_duplicates),
    ("personal data", remove_personal_data),
    ("packing", pack_sequences),
]

#: Fitted models and tokenisers decide rows: SQL cannot say it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
