"""From scores to exposure, and the tables and sweeps built on exposure."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.columns import literal_doubles
from tidemark.functions.scoring import Regime, score_long
from tidemark.operators.ranks import exact_quantiles, join_figures


def exposure(score: Column, reference: Column, baseline: float | Column = K.BASELINE_EXPOSURES) -> Column:
    """Clipped total exposure; a reference that is not a positive number gives score 1."""
    usable = reference.isNotNull() & ~F.isnan(reference) & (reference > 0) & (
        reference < F.lit(float("inf"))
    )
    rel = F.when(usable, score / reference).otherwise(F.lit(1.0))
    base = baseline if isinstance(baseline, Column) else F.lit(float(baseline))
    return F.least(F.greatest(base * rel, F.lit(K.EXPOSURE_MIN)), F.lit(K.EXPOSURE_MAX))


def score_reference(long: DataFrame, keys: Sequence[str] = ("regime",), mode: str = "median") -> DataFrame:
    """Median or mean score per key, column ``reference``."""
    if mode == "median":
        return exact_quantiles(long, "score", {"reference": 0.5}, keys).select(*keys, "reference")
    if mode == "mean":
        return long.groupBy(*keys).agg(F.avg("score").alias("reference"))
    raise ValueError(f"unknown normalisation {mode!r}")


def with_reach(
    long: DataFrame,
    keys: Sequence[str] = ("regime",),
    baseline: float | Column = K.BASELINE_EXPOSURES,
    mode: str = "median",
) -> DataFrame:
    """Add ``rel_score`` and ``reach`` to rows of (keys, score).

    The reference table has one row per key, so it joins as a lookup.
    """
    joined = join_figures(long, score_reference(long, keys, mode), keys)
    usable = F.col("reference") > 0
    return joined.select(
        *[c for c in long.columns],
        F.when(usable, F.col("score") / F.col("reference")).otherwise(F.lit(1.0)).alias("rel_score"),
        exposure(F.col("score"), F.col("reference"), baseline).alias("reach"),
    )


def class_means(reach: DataFrame, keys: Sequence[str], value: str = "reach", label: str = "label") -> DataFrame:
    """Mean of ``value`` for the low and high class per key, and low minus high."""
    low = F.avg(F.when(F.col(label) == K.LOW, F.col(value)))
    high = F.avg(F.when(F.col(label) == K.HIGH, F.col(value)))
    return (
        reach.groupBy(*keys)
        .agg(low.alias("low_mean"), high.alias("high_mean"))
        .withColumn("gap", F.col("low_mean") - F.col("high_mean"))
    )


def against_baseline(table: DataFrame, value: str, baseline: str, key: str = "regime", within: Sequence[str] = ()) -> Column:
    """The baseline row's ``value``, over a result table of one row per regime."""
    w = Window.partitionBy(*(list(within) or [F.lit(1)]))
    return F.max(F.when(F.col(key) == baseline, F.col(value))).over(w)


def gap_contrasts(reach: DataFrame, baseline: str = "additive") -> DataFrame:
    """Point gap per regime and its difference from the baseline regime's gap."""
    table = class_means(reach, ["regime"])
    return table.withColumn("contrast", F.col("gap") - against_baseline(table, "gap", baseline))


def reach_table(reach: DataFrame, baseline: str = "additive") -> DataFrame:
    """Class means, percentage reductions against the baseline, selectivity and gap."""
    table = class_means(reach, ["regime"])
    low0 = against_baseline(table, "low_mean", baseline)
    high0 = against_baseline(table, "high_mean", baseline)
    out = table.select(
        "*",
        (F.lit(100.0) * (low0 - F.col("low_mean")) / low0).alias("low_reduction_pct"),
        (F.lit(100.0) * (high0 - F.col("high_mean")) / high0).alias("high_reduction_pct"),
    )
    return out.withColumn("selectivity", F.col("low_reduction_pct") - F.col("high_reduction_pct"))


def operating_curve(
    seeds: DataFrame, floors: Iterable[float] = K.FLOOR_GRID, scale: float = K.FLOOR_SCALE,
    baseline: float = K.BASELINE_EXPOSURES,
) -> DataFrame:
    """Budget-neutral benefit and cost of every floor value.

    Reductions are taken on class shares of mean reach, so a rescaling common to
    both classes does not count.
    """
    regimes = [Regime("additive", "additive")] + [
        Regime(f"{f:.1f}", "reflective_floor", floor=f, floor_scale=scale) for f in floors
    ]
    reach = with_reach(score_long(seeds, regimes, ["label"]), baseline=baseline)
    table = class_means(reach, ["regime"])
    middle = (F.col("low_mean") + F.col("high_mean")) / F.lit(2.0)
    table = table.select(
        "*", (F.col("low_mean") / middle).alias("low_share"), (F.col("high_mean") / middle).alias("high_share")
    )
    low0 = against_baseline(table, "low_share", "additive")
    high0 = against_baseline(table, "high_share", "additive")
    out = table.select(
        "*",
        (F.lit(100.0) * (F.lit(1.0) - F.col("low_share") / low0)).alias("low_reduction_pct"),
        (F.lit(100.0) * (F.lit(1.0) - F.col("high_share") / high0)).alias("high_reduction_pct"),
        (F.col("gap") - against_baseline(table, "gap", "additive")).alias("gap_change"),
    ).where(F.col("regime") != "additive")
    return out.select(
        F.col("regime").cast("double").alias("floor"),
        "low_mean",
        "high_mean",
        "low_reduction_pct",
        "high_reduction_pct",
        (F.col("low_reduction_pct") - F.col("high_reduction_pct")).alias("selectivity"),
        "gap",
        "gap_change",
        (F.col("low_share") - F.col("high_share")).alias("gap_share"),
    )


def operating_points(curve: DataFrame, budget: float = K.COLLATERAL_BUDGET_PCT) -> DataFrame:
    """The most selective floor, and the strongest one whose cost stays in budget.

    No floor within budget gives a row of nulls for that choice.
    """
    row = F.struct(*curve.columns)
    best = curve.agg(
        F.max_by(row, F.struct("selectivity", -F.col("floor"))).alias("selectivity"),
        F.max_by(
            F.when(F.col("high_reduction_pct") <= budget, row),
            F.when(
                F.col("high_reduction_pct") <= budget,
                F.struct("low_reduction_pct", -F.col("floor")),
            ),
        ).alias("budget"),
    )
    cells = F.array(
        *[F.struct(F.lit(c).alias("choice"), F.col(c).alias("r")) for c in ("selectivity", "budget")]
    )
    return best.select(F.inline(cells)).select("choice", "r.*")


def hourly_plan(
    seeds: DataFrame,
    weights: DataFrame,
    total: str = "reach",
    epoch: str = "epoch",
    n_bins: int = K.N_TIME_BINS,
    tau: float = K.DECAY_TAU_HOURS,
    circadian: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Split each seed's exposure over hours: decay times the weight of the clock hour.

    ``weights`` is (hour, weight), 24 rows. A seed's shape depends on its start's hour of the
    day alone, so the 24 shapes and their sums are made once and a seed looks its own up.
    """
    decays = literal_doubles([math.exp(-t / max(tau, 1e-6)) for t in range(n_bins)])

    def summed(shape: Column) -> Column:
        return F.aggregate(shape, F.lit(0.0), lambda a, x: a + x)

    if circadian:
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("hour", "weight"))), lambda s: s["weight"])
        shape = F.transform(decays, lambda d, t: d * F.element_at(F.col("w"), F.pmod(F.col("start") + t, F.lit(24)) + 1))
        shapes = weights.agg(in_order.alias("w")).select("w", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("start")).select("start", shape.alias("parts"))
        cells = F.array_sort(F.collect_list(F.struct("start", "parts", summed(F.col("parts")).alias("sum"))))
        start = F.pmod(F.floor(F.col(epoch) / F.lit(3600.0)), F.lit(24)).cast("int")
        own = F.element_at(shapes.agg(cells).scalar(), start + 1)
        unknown = F.array_repeat(F.lit(None).cast("double"), n_bins)  # a seed without a time keeps its hours
        parts, total_part = F.coalesce(own["parts"], unknown), own["sum"]
    else:
        parts, total_part = decays, summed(decays)
    exploded = seeds.select(*keep, total, total_part.alias("__sum"), F.posexplode(parts).alias("t_hour", "__part"))
    return exploded.select(
        *keep, "t_hour", (F.col("__part") / F.col("__sum") * F.col(total)).alias("planned")
    )


def expected_engagement(plan: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Expected events per hour and head: planned exposure times the propensity."""
    return plan.select(
        *keep,
        "t_hour",
        *[(F.col("planned") * F.col(f"p_{h}")).alias(f"expected_{h}") for h in K.HEADS],
    )
