"""Exposure calibration against observed reply counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.scoring import Regime
from tidemark.operators.ranks import ordered_counts, quantile_parts
from tidemark.operators.reach import score_reference

MODES = ("mean", "zero_inflated", "zero_inflated_nb")


def expected_factor(seeds: DataFrame, regime: Regime | None = None, mode: str = "median") -> DataFrame:
    """One row: mean over seeds of relative score times reply propensity, and n."""
    scored = seeds.select(
        (regime or Regime("additive", "additive")).score().alias("score"), "p_reply"
    )
    reference = score_reference(scored, (), mode).scalar()
    rel = F.when(F.col("__r") > 0, F.col("score") / F.col("__r")).otherwise(F.lit(1.0))
    return scored.withColumn("__r", reference).agg(
        F.greatest(F.avg(rel * F.col("p_reply")), F.lit(K.FACTOR_MIN)).alias("factor"),
        F.count(F.lit(1)).alias("n_seeds"),
    )


def observed_moments(observed: DataFrame, value: str = "reply_count") -> DataFrame:
    """Mean, share of zeros and moments of the positive part, plain and trimmed.

    The cut at the 95th percentile and the moments below it both read the ordered
    counts, so the observed values are sorted once.
    """
    counts = ordered_counts(observed, value)
    positive = ordered_counts(observed.where(F.col(value) > 0), value)
    parts, made = quantile_parts(value, {"cutoff": 1.0 - K.CALIBRATION_TRIM})
    cutoff = positive.agg(*parts).select(*made).scalar()
    v, n = F.col(value), F.col("n")
    overall = counts.agg(
        F.sum("n").alias("n_observed"),
        (F.sum(v * n) / F.sum(n)).alias("mean"),
        (F.sum(F.when(v == 0, n).otherwise(0)) / F.sum(n)).alias("p_zero"),
    ).select(F.struct("n_observed", "mean", "p_zero").alias("o")).scalar()
    cut = positive.withColumn("__cut", cutoff)
    kept = F.when(v <= F.col("__cut"), n)
    sums = cut.agg(
        F.sum(n).cast("double").alias("n"), F.sum(v * n).alias("s"), F.sum(kept).cast("double").alias("tn"), F.sum(v * kept).alias("ts"))
    means = sums.select(F.struct("n", "s", "tn", "ts").alias("m")).scalar()
    # Around the means, found before: a sum of squares loses what large values have in common.
    off, trimmed_off = v - F.try_divide(F.col("__m.s"), F.col("__m.n")), v - F.try_divide(F.col("__m.ts"), F.col("__m.tn"))
    sums = cut.withColumn("__m", means).agg(
        F.max("__m.n").alias("n"), F.max("__m.s").alias("s"), F.max("__m.tn").alias("tn"), F.max("__m.ts").alias("ts"),
        F.sum(off * off * n).alias("ss"), F.sum(trimmed_off * trimmed_off * kept).alias("tss"))

    def variance(c: str, s: str, ss: str):
        return F.when(F.col(c) >= 2, F.col(ss) / (F.col(c) - 1))

    trimmed = F.col("n") >= K.CALIBRATION_MIN_ROWS
    return sums.withColumn("o", overall).select(
        "o.n_observed", "o.mean", "o.p_zero",
        F.try_divide(F.col("s"), F.col("n")).alias("positive_mean"),
        variance("n", "s", "ss").alias("positive_var"),
        F.when(trimmed, F.try_divide(F.col("ts"), F.col("tn"))).otherwise(F.try_divide(F.col("s"), F.col("n"))).alias("trimmed_mean"),
        F.when(trimmed, variance("tn", "ts", "tss")).otherwise(variance("n", "s", "ss")).alias("trimmed_var"),
    )


def calibrate(observed: DataFrame, seeds: DataFrame, value: str = "reply_count") -> DataFrame:
    """One row per target mode with baseline exposures, activity rate and dispersion.

    Columns a mode does not use are null.
    """
    factor = expected_factor(seeds).select(F.struct("factor", "n_seeds").alias("f")).scalar()
    m = observed_moments(observed, value).withColumn("f", factor)
    room = F.col("trimmed_var") - F.col("trimmed_mean")
    dispersion = F.when(
        F.col("trimmed_var").isNull() | (room <= 0), F.lit(K.DISPERSION_MAX)
    ).otherwise(
        F.least(
            F.greatest(F.col("trimmed_mean") * F.col("trimmed_mean") / room, F.lit(K.DISPERSION_MIN)),
            F.lit(K.DISPERSION_MAX),
        )
    )
    activity = F.least(F.greatest(F.lit(1.0) - F.col("p_zero"), F.lit(K.FACTOR_MIN)), F.lit(1.0))
    inflated = F.col("target_mode") != "mean"
    nb = F.col("target_mode") == "zero_inflated_nb"
    modes = F.explode(F.array(*[F.lit(x) for x in MODES])).alias("target_mode")
    return m.select("*", modes).select(
        "target_mode",
        F.col("mean").alias("target_mean"),
        F.col("f.factor").alias("expected_factor"),
        (F.when(inflated, F.col("positive_mean")).otherwise(F.col("mean")) / F.col("f.factor")).alias("baseline_exposures"),
        "n_observed",
        F.col("f.n_seeds").alias("n_seeds"),
        F.when(inflated, activity).alias("activity"),
        F.when(inflated, F.col("p_zero")).alias("target_p_zero"),
        F.when(inflated, F.col("positive_mean")).alias("target_positive_mean"),
        F.when(nb, dispersion).alias("dispersion"),
        F.when(nb, F.col("positive_var")).alias("target_positive_var"),
    )
