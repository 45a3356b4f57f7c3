"""Descriptive tables of a post table and of derived columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.columns import equal_width_bucket, flag_or_false, no_nan, share
from tidemark.operators.ranks import join_on, exact_quantiles, ordered_counts, quantile_parts, unpivot

PROFILE_PROBES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def type_shares(posts: DataFrame) -> DataFrame:
    return posts.agg(
        F.count(F.lit(1)).alias("n_posts"),
        *[share(F.col(f"is_{t}")).alias(f"share_{t}") for t in ("reply", "quote", "retweet", "original")],
    )


def numeric_profile(
    df: DataFrame,
    columns: Sequence[str],
    probes: Mapping[str, float] = PROFILE_PROBES,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Count, mean, sample deviation, quantiles, range and non-zero share per column and key.

    One ordered-count job serves every column: the columns become rows first.
    """
    group = [*keys, "metric"]
    long = unpivot(df, columns, keys)
    # The deviation is updated row by row: a sum of squares loses values of the size of epochs.
    rows = long.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows"), F.stddev_samp(no_nan("value")).alias("__std"))
    ordered = ordered_counts(long, "value", group)
    parts, made = quantile_parts("value", probes)
    v, n = F.col("value"), F.col("n")
    stats = ordered.groupBy(*group).agg(
        F.max("tot_n").alias("count"),
        F.sum(v * n).alias("__sum"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.sum(F.when(v > 0, n).otherwise(0)).alias("__positive"),
        *parts,
    )
    c = F.col("count").cast("double")
    mean = F.col("__sum") / c
    return (
        join_on(stats, rows, group)
        .select(
            *group, "count", mean.alias("mean"), F.when(c > 1, F.col("__std")).alias("std"),
            "min", *made, "max", (F.col("__positive") / F.col("n_rows")).alias("nonzero_share"),
        )
    )


def flag_shares(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Share of true per flag; null counts as false."""
    return df.agg(*[F.avg(flag_or_false(f).cast("double")).alias(f"share_{f}") for f in flags])


def conversation_sizes(posts: DataFrame, conversation: str = "conversationId") -> DataFrame:
    """Number of conversations, size thresholds, median, 95th percentile and maximum."""
    sizes = (
        posts.where(no_nan(conversation).isNotNull())
        .groupBy(conversation)
        .agg(F.count(F.lit(1)).alias("size"))
    )
    parts, made = quantile_parts("size", {"median_size": 0.5, "p95_size": 0.95})
    n = F.col("n")
    return (
        ordered_counts(sizes, "size")
        .agg(
            F.sum("n").alias("n_conversations"),
            *[F.sum(F.when(F.col("size") >= k, n).otherwise(0)).alias(f"n_size_ge_{k}") for k in (2, 5, 20)],
            F.max("size").cast("long").alias("max_size"),
            *parts,
        )
        .select("n_conversations", "n_size_ge_2", "n_size_ge_5", "n_size_ge_20", *made, "max_size")
    )


def url_coverage(posts: DataFrame, urls: str = "link_urls") -> DataFrame:
    n = F.coalesce(F.size(urls), F.lit(0))
    return posts.agg(
        share(n > 0).alias("share_with_url"),
        F.sum(F.when(n > 0, 1).otherwise(0)).alias("n_with_url"),
        F.avg(n.cast("double")).alias("mean_urls"),
    )


def diurnal_weights(df: DataFrame, epoch: str = "epoch", normalize: bool = True) -> DataFrame:
    """Posts per UTC hour scaled to mean 1: rows (hour, weight), 24 of them always.

    Hours without posts get 0; a table without any timed post gets all ones.
    """
    hour = F.pmod(F.floor(no_nan(epoch) / F.lit(3600.0)), F.lit(24)).cast("int")
    counts = df.agg(
        *[F.sum(F.when(hour == h, 1).otherwise(0)).cast("double").alias(f"h{h}") for h in range(24)],
        F.count(hour).cast("double").alias("total"),
    )
    cells = F.array(
        *[F.struct(F.lit(h).alias("hour"), F.coalesce(F.col(f"h{h}"), F.lit(0.0)).alias("n")) for h in range(24)]
    )
    scaled = F.col("n") * (F.lit(24.0) / F.col("total")) if normalize else F.col("n")
    return counts.select("total", F.inline(cells)).select(
        "hour", F.when(F.col("total") > 0, scaled).otherwise(F.lit(1.0)).alias("weight")
    )


def group_summary(
    df: DataFrame, value: str, keys: Sequence[str], threshold: float = K.DEMOTED_POINTS
) -> DataFrame:
    """n, mean, median, 10th and 90th percentile, shares beyond plus and minus threshold."""
    parts, made = quantile_parts(value, {"median": 0.5, "q10": 0.1, "q90": 0.9})
    v, n = F.col(value), F.col("n")
    total = F.col("count")
    return (
        ordered_counts(df, value, keys)
        .groupBy(*keys)
        .agg(
            F.max("tot_n").alias("count"),
            F.sum(v * n).alias("__sum"),
            F.sum(F.when(v > threshold, n).otherwise(0)).alias("__above"),
            F.sum(F.when(v < -threshold, n).otherwise(0)).alias("__below"),
            *parts,
        )
        .select(
            *keys, "count", (F.col("__sum") / total).alias("mean"), *made,
            (F.col("__above") / total).alias("share_above"), (F.col("__below") / total).alias("share_below"),
        )
    )


def histogram(df: DataFrame, value: str, bins: int = 45, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over the whole range; density integrates to 1 per key."""
    known = df.withColumn(value, no_nan(value)).where(F.col(value).isNotNull())
    span = known.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    placed = known.select(*keys, value, span.alias("s"))
    counts = placed.groupBy(
        *keys, equal_width_bucket(F.col(value), F.col("s.lo"), F.col("s.hi"), bins).alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"), F.min("s.lo").alias("lo"), F.max("s.hi").alias("hi"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total")) if keys else counts.agg(F.sum("n").alias("total"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    joined = counts.join(totals, list(keys)) if keys else counts.withColumn("total", totals.scalar())
    return joined.select(
        *keys, "bin", (F.col("lo") + width * F.col("bin")).alias("left_edge"), "n",
        F.try_divide(F.col("n"), F.col("total") * width).alias("density"),
    )


def binned_means(
    df: DataFrame, x: str, y: str, keys: Sequence[str] = (), bins: int = 12, min_rows: int = 5
) -> DataFrame:
    """Mean of y in equal-width left-closed bins of x; the overall maximum falls in none."""
    span = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    placed = df.select(*keys, x, y, span.alias("s")).where(F.col(x) < F.col("s.hi"))
    width = (F.col("lo_hi.hi") - F.col("lo_hi.lo")) / F.lit(float(bins))
    return (
        placed.groupBy(*keys, equal_width_bucket(F.col(x), F.col("s.lo"), F.col("s.hi"), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_y"), F.max("s").alias("lo_hi"))
        .where(F.col("n") >= min_rows)
        .select(*keys, "bin", (F.col("lo_hi.lo") + width * (F.col("bin") + F.lit(0.5))).alias("center"), "n", "mean_y")
    )


def class_comparison(df: DataFrame, measures: Mapping[str, Column], label: str = "label") -> DataFrame:
    """One row per measure: mean in the low class, in the high class, and the difference."""
    aggs = []
    for name, column in measures.items():
        for cls, short in ((K.LOW, "low"), (K.HIGH, "high")):
            aggs.append(F.avg(F.when(F.col(label) == cls, column.cast("double"))).alias(f"{name}__{short}"))
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("measure"), F.col(f"{n}__low").alias("low"), F.col(f"{n}__high").alias("high"))
            for n in measures
        ]
    )
    return df.agg(*aggs).select(F.inline(cells)).withColumn("low_minus_high", F.col("low") - F.col("high"))


def mechanism_verdicts(comparison: DataFrame) -> DataFrame:
    """Does the low class get the lower gate, more suppression and more demotion?"""

    def low_less(measure: str) -> Column:
        return F.max(F.when(F.col("measure") == measure, F.col("low") < F.col("high")))

    def low_more(measure: str) -> Column:
        return F.max(F.when(F.col("measure") == measure, F.col("low") > F.col("high")))

    row = comparison.agg(
        low_less("gate").alias("low_lower_gate"),
        low_more("gate_below_half").alias("low_more_suppressed"),
        low_less("disp_ablated").alias("low_more_displaced_ablated"),
        low_less("disp_floor").alias("low_more_displaced_floor"),
    )
    return row.withColumn(
        "demotes_low_more",
        F.col("low_lower_gate") & F.col("low_more_suppressed")
        & F.col("low_more_displaced_ablated") & F.col("low_more_displaced_floor"),
    )


def decile_composition(df: DataFrame, value: str, group: str, id_col: str) -> DataFrame:
    """Make-up of the top tenth of ``value`` by group against the whole table.

    The tenth is n // 10 rows in the total order (value, id). Which distinct value
    the cut falls in comes from ordered counts; only rows at that one value are
    ranked by id, and those again through ordered counts.
    """
    ordered = ordered_counts(df, value)
    above = F.col("tot_n") - F.col("cum_n")
    need = F.floor(F.col("tot_n") / 10)
    cut = ordered.where((above < need) & (above + F.col("n") >= need)).select(
        F.struct(F.col(value).alias("v"), (need - above).alias("k")).alias("cut")
    ).scalar()
    at_cut, taken = cut.getField("v"), cut.getField("k")
    ties = df.where(F.col(value) == at_cut).select(F.col(id_col).cast("double").alias("__id"))
    last_id = (
        ordered_counts(ties, "__id")
        .where(F.col("tot_n") - F.col("cum_n") + 1 == taken)
        .agg(F.min("__id"))
        .scalar()
    )
    inside = (F.col(value) > at_cut) | (
        (F.col(value) == at_cut) & (F.col(id_col).cast("double") >= last_id)
    )
    counts = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_all"), F.sum(F.when(inside, 1).otherwise(0)).alias("n_top")
    )
    totals = counts.agg(F.struct(F.sum("n_all").alias("all"), F.sum("n_top").alias("top"))).scalar()
    share_top = F.try_divide(F.col("n_top"), F.col("__t.top"))
    base = F.col("n_all") / F.col("__t.all")
    return counts.withColumn("__t", totals).select(
        group, "n_top", share_top.alias("share"), base.alias("baseline_share"),
        (share_top / base).alias("enrichment"),
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, min, quartiles and max per column."""
    return numeric_profile(df, columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75}).drop("nonzero_share")


def quantile_edges(df: DataFrame, value: str, bins: int) -> Column:
    """Edges of equal-frequency bins as a scalar array, equal edges collapsed; empty without values."""
    names = {f"e{i}": i / bins for i in range(bins + 1)}
    return exact_quantiles(df, value, names).select(F.array_compact(F.array_distinct(F.array(*names)))).scalar()
