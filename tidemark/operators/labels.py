"""Credibility labels from links and emotion labels from words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.operators.ranks import quantile_scalars

_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:@]*)"


def host_of(url: Column) -> Column:
    """Lower-case host of a link, with or without a scheme; no trailing dot."""
    return F.lower(F.rtrim(F.regexp_extract(F.trim(url), _HOST, 1), F.lit(".")))


def registered_domains(hosts: DataFrame, suffixes: DataFrame, unlisted: bool = False) -> DataFrame:
    """(host, domain) for distinct hosts: the public suffix plus one label.

    ``suffixes`` holds rules of a public-suffix list (see ``sources.lists.suffix_rules``): plain
    ones, ``*.`` rules that take one more label, and ``!`` rules that take one less and win over
    all. Else the longest rule decides; a host that no rule meets is left out, or has its last
    label for a suffix where ``unlisted``. Hosts equal to a suffix, addresses, and texts with
    characters no host has get no row. Every host yields one candidate suffix per label,
    matched by an equi-join, so the rule table may have any size.
    """
    distinct = hosts.select("host").where(F.col("host").rlike(r"^[^\s]+\.[^\s]+$") & ~F.col("host").rlike(r"\.[0-9]+$")).distinct()
    labels = distinct.select("host", F.split("host", r"\.").alias("labels"))
    candidates = labels.select("host", F.posexplode(
        F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.concat_ws(".", F.slice("labels", i, F.size("labels"))))).alias("at", "suffix"))
    rules = suffixes if "kind" in suffixes.columns else suffixes.withColumn("kind", F.lit("plain"))
    # Where the public suffix begins, counted from 0.
    begins = F.col("at") + F.when(F.col("kind") == "exception", 1).when(F.col("kind") == "wildcard", -1).otherwise(0)
    met = candidates.join(rules, "suffix").where(begins >= 0).groupBy("host").agg(
        F.min(F.struct((F.col("kind") != "exception").alias("listed"), begins.alias("begin"))).alias("m"))
    begin = F.coalesce("m.begin", F.size("labels") - 1) if unlisted else F.col("m.begin")
    placed = labels.join(met, "host", "left" if unlisted else "inner").select("host", "labels", begin.alias("begin"))
    named = placed.where((F.col("begin") >= 1) & (F.get("labels", F.col("begin") - 1) != ""))
    return named.select("host", F.concat_ws(".", F.slice("labels", F.col("begin"), F.size("labels"))).alias("domain"))


def url_labels(
    posts: DataFrame, low: DataFrame, high: DataFrame, suffixes: DataFrame,
    key: str = "id_str", urls: str = "link_urls",
) -> DataFrame:
    """(key, label) of posts whose links reach either list; both lists give ``mixed``.

    Only links on a list survive the joins, so what is grouped per post is the
    labelled few per cent, not every link.
    """
    links = posts.select(key, F.explode(urls).alias("url")).select(key, host_of(F.col("url")).alias("host"))
    domains = registered_domains(links, suffixes)
    listed = low.select("domain", F.lit(True).alias("low")).unionByName(
        high.select("domain", F.lit(False).alias("low"))
    )
    hits = links.join(domains.join(listed, "domain"), "host")
    sides = hits.groupBy(key).agg(F.bool_or("low").alias("any_low"), F.bool_or(~F.col("low")).alias("any_high"))
    label = (
        F.when(F.col("any_low") & F.col("any_high"), K.MIXED)
        .when(F.col("any_low"), K.LOW)
        .otherwise(K.HIGH)
    )
    return sides.select(key, label.alias("credibility_label"))


def add_url_labels(posts: DataFrame, low: DataFrame, high: DataFrame, suffixes: DataFrame,
                   key: str = "id_str", urls: str = "link_urls") -> DataFrame:
    """``posts`` with a nullable ``credibility_label``."""
    return posts.join(url_labels(posts, low, high, suffixes, key, urls), key, "left")


def label_coverage(posts: DataFrame, label: str = "credibility_label",
                   classes: Sequence[str] = (K.LOW, K.HIGH, K.MIXED)) -> DataFrame:
    """Total, count per class, unlabelled rest and labelled share."""
    hits = [F.sum(F.when(F.col(label) == c, 1).otherwise(0)) for c in classes]
    labelled = hits[0]
    for h in hits[1:]:
        labelled = labelled + h
    total = F.count(F.lit(1))
    return posts.agg(
        total.alias("total"),
        *[h.alias(c) for h, c in zip(hits, classes)],
        (total - labelled).alias("unlabeled"),
        F.coalesce(F.try_divide(labelled, total), F.lit(0.0)).alias("labeled_share"),
    )


# ---- emotion -------------------------------------------------------------


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and apostrophes."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({K.TOKEN_PATTERN})"), F.lit(1))


def emotion_scores(posts: DataFrame, words: DataFrame, key: str, text: str) -> DataFrame:
    """(key, emotion_score): lexicon hits over tokens, repeats counted, 0 without tokens.

    Tokens are counted per (post, word) before the lexicon join; a long text is
    one row per distinct word.
    """
    split = posts.select(key, tokens(F.col(text)).alias("t"))
    hits = (
        split.select(key, F.explode("t").alias("word"))
        .join(words.select("word").distinct(), "word")
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("hits"))
    )
    sized = split.select(key, F.size("t").alias("n"))
    return sized.join(hits, key, "left").select(
        key, F.coalesce(F.try_divide(F.coalesce("hits", F.lit(0)), F.col("n")), F.lit(0.0)).alias("emotion_score")
    )


def emotion_scores_inline(posts: DataFrame, words: Sequence[str], key: str, text: str) -> DataFrame:
    """The same score with the lexicon as a literal: no join and no shuffle.

    For word lists short enough to sit in the plan.
    """
    listed = F.array(*[F.lit(w.lower()) for w in words])
    t = posts.select(key, tokens(F.col(text)).alias("t"))
    hits = F.size(F.filter("t", lambda w: F.array_contains(listed, w)))
    return t.select(key, F.coalesce(F.try_divide(hits, F.size("t")), F.lit(0.0)).alias("emotion_score"))


def emotion_labels(scores: DataFrame, high_quantile: float = K.HIGH_EMOTION_QUANTILE) -> DataFrame:
    """Low at exactly 0, high at or above the quantile of the non-zero scores, else null.

    Scores are compared in single precision. A table without a single hit is an
    error, raised when the query runs.
    """
    single = scores.withColumn("emotion_score", F.col("emotion_score").cast("float").cast("double"))
    positive = single.where(F.col("emotion_score") > 0)
    threshold = F.coalesce(
        quantile_scalars(positive, "emotion_score", {"q": high_quantile}).getField("q"),
        F.raise_error(F.lit("no lexicon hits in any text")).cast("double"),
    )
    marked = single.withColumn("__threshold", threshold)
    s = F.col("emotion_score")
    return marked.select(
        *scores.columns,
        F.when(s >= F.col("__threshold"), K.HIGH_EMOTION).when(s == 0, K.LOW_EMOTION).alias("emotion_label"),
    )


def emotion_coverage(labelled: DataFrame) -> DataFrame:
    return label_coverage(labelled, "emotion_label", (K.HIGH_EMOTION, K.LOW_EMOTION)).withColumnRenamed(
        "unlabeled", "unlabeled_middle"
    )
