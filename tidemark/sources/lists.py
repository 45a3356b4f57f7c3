"""Label lists, lexicon and suffix list as small DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import constants as K


def low_credibility_domains(spark: SparkSession, path: str) -> DataFrame:
    """The ``Domain`` column of a CSV, trimmed, lowered, distinct; an error when absent."""
    table = spark.read.csv(path, header=True)
    if "Domain" not in table.columns:
        raise ValueError(f"expected a Domain column in {path}, got {table.columns}")
    domain = F.lower(F.trim("Domain"))
    return table.select(domain.alias("domain")).where("domain <> ''").distinct()


def high_credibility_domains(spark: SparkSession, path: str) -> DataFrame:
    """One domain per line; text after ``#`` is a comment."""
    domain = F.lower(F.trim(F.split("value", "#")[0]))
    return spark.read.text(path).select(domain.alias("domain")).where("domain <> ''").distinct()


def emotion_words(spark: SparkSession, path: str, emotions: Iterable[str] = K.EMOTIONS) -> DataFrame:
    """Words flagged 1 for any of ``emotions`` in a word/emotion/flag TSV."""
    table = spark.read.csv(path, sep="\t", schema="word string, emotion string, flag int")
    kept = table.where(F.col("emotion").isin(list(emotions)) & (F.col("flag") == 1))
    return kept.select(F.lower("word").alias("word")).distinct()


def rules_of(lines: DataFrame) -> DataFrame:
    """``(suffix, kind)`` of the ``value`` lines of a public-suffix list.

    A line's rule is its text up to white space; empty lines and ``//`` comments have none.
    ``*.x`` is the wildcard rule of x, ``!x`` the exception x; everything else is plain.
    """
    rule = F.lower(F.split(F.trim("value"), r"\s")[0])
    kind = F.when(rule.startswith("!"), "exception").when(rule.startswith("*."), "wildcard").otherwise("plain")
    rules = lines.where((rule != "") & ~rule.startswith("//"))
    return rules.select(F.regexp_replace(rule, r"^(!|\*\.)", "").alias("suffix"), kind.alias("kind")).where("suffix <> ''").distinct()


def suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a public-suffix list file."""
    return rules_of(spark.read.text(path))


def public_suffixes(spark: SparkSession, suffixes: Iterable[str] = K.PUBLIC_SUFFIXES) -> DataFrame:
    """Rule rows; pass the full public list when it is at hand."""
    return rules_of(spark.createDataFrame([(s,) for s in suffixes], "value string"))


def domain_frame(spark: SparkSession, domains: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(d.strip().lower(),) for d in domains], "domain string").distinct()


def list_overlap(low: DataFrame, high: DataFrame) -> DataFrame:
    """Domains on both lists."""
    return low.select("domain").intersect(high.select("domain"))
