"""Group gaps and regime contrasts over a panel, with bootstrap intervals.

A panel row is (regime, replicate, cascade_id, label, n_reply, n_retweet, n_like,
n_deep, total_exposures). Metrics are Columns over such a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.operators.ranks import join_on
from tidemark.session import stage

_MODULUS = 2147483647


def cascade_size() -> Column:
    """Replies, retweets and quotes; likes are no part of a cascade's size."""
    return (F.col("n_reply") + F.col("n_retweet") + F.col("n_deep")).cast("double")


def audience_reach() -> Column:
    return F.col("total_exposures")


def panel_ratio() -> Column:
    return F.col("n_reply") / (F.col("n_retweet") + F.col("n_deep") + F.lit(1.0))


def panel_peaks(hourly: DataFrame, keys: Sequence[str] = ("regime", "replicate", "cascade_id")) -> DataFrame:
    """Hour with most replies per cascade, the smallest hour on ties."""
    return hourly.groupBy(*keys).agg(
        F.max_by("t_hour", F.struct(F.col("n_reply"), -F.col("t_hour"))).alias("t_peak")
    )


def planned_peak(replies: Column, shares: Column, n_bins: int = K.N_TIME_BINS) -> Column:
    """The peak hour of ``panel_peaks`` where each hour has a share of the row's replies, whole ones counted; 0 without shares.

    One number a bin, its replies before its place from the end, keeps the comparison in generated code.
    """
    room = 1 << (n_bins - 1).bit_length()
    ranked = [F.floor(replies * F.get(shares, F.lit(t))).cast("long") * room + (room - 1 - t) for t in range(n_bins)]
    return F.coalesce((room - 1 - F.pmod(F.greatest(*ranked), F.lit(room))).cast("int"), F.lit(0))


def with_peaks(panel: DataFrame, hourly: DataFrame) -> DataFrame:
    """Panel rows with their peak hour, 0 where the hourly table has none."""
    keys = ["regime", "replicate", "cascade_id"]
    return panel.join(panel_peaks(hourly, keys), keys, "left").withColumn("t_peak", F.coalesce("t_peak", F.lit(0)))


# ---- replicate level -----------------------------------------------------


def replicate_gaps(panel: DataFrame, metric: Column, label: str = "label") -> DataFrame:
    """Low minus high mean per (regime, replicate); a replicate lacking a class is an error."""
    low, high = F.col(label) == K.LOW, F.col(label) == K.HIGH
    v = metric.cast("double")
    means = panel.where(low | high).groupBy("regime", "replicate").agg(
        F.avg(F.when(low, v)).alias("low_mean"),
        F.avg(F.when(high, v)).alias("high_mean"),
        F.sum(F.when(low, 1).otherwise(0)).alias("n_low"),
        F.sum(F.when(high, 1).otherwise(0)).alias("n_high"),
    )
    missing = F.col("low_mean").isNull() | F.col("high_mean").isNull()
    gap = F.when(missing, F.raise_error(F.lit("a replicate lacks low or high cascades")).cast("double")).otherwise(
        F.col("low_mean") - F.col("high_mean")
    )
    return means.withColumn("gap", gap)


def _interval(value: str) -> list[Column]:
    """Mean and central 95% over replicates; their number is a parameter, so it fits a task."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return [F.avg(value).alias("mean"), q[0].alias("ci_lo"), q[1].alias("ci_hi")]


def regime_gaps(gaps: DataFrame) -> DataFrame:
    """Per regime: mean gap, interval, number of replicates, median class sizes."""
    return gaps.groupBy("regime").agg(
        F.count(F.lit(1)).alias("n_replicates"),
        *_interval("gap"),
        F.percentile("n_low", F.lit(0.5)).cast("long").alias("n_low"),
        F.percentile("n_high", F.lit(0.5)).cast("long").alias("n_high"),
    )


def replicate_contrasts(gaps: DataFrame, baseline: str = "additive") -> DataFrame:
    """Per regime: difference from the baseline's gap, replicate by replicate.

    A replicate one of the two regimes lacks is an error.
    """
    base = gaps.where(F.col("regime") == baseline).select("replicate", F.col("gap").alias("__base"))
    others = gaps.where(F.col("regime") != baseline)
    expected = base.agg(F.count(F.lit(1))).scalar()
    paired = others.join(base, "replicate", "left").withColumn(
        "diff",
        F.when(
            F.col("__base").isNull(), F.raise_error(F.lit("regimes differ in replicates")).cast("double")
        ).otherwise(F.col("gap") - F.col("__base")),
    )
    out = paired.groupBy("regime").agg(F.count(F.lit(1)).alias("n_replicates"), *_interval("diff"))
    return out.withColumn(
        "mean",
        F.when(
            F.col("n_replicates") != expected,
            F.raise_error(F.lit("regimes differ in replicates")).cast("double"),
        ).otherwise(F.col("mean")),
    )


# ---- cascade level -------------------------------------------------------


def replicate_means(panel: DataFrame, metrics: Mapping[str, Column], regimes: Sequence[str],
                    label: str = "label", keep: Sequence[str] = ()) -> DataFrame:
    """One row per cascade, one column ``<metric>__<regime>`` each: the mean over replicates.

    Cascades missing under any regime drop out. A conditional aggregate does the
    pivot, so the columns are known before the job runs.
    """
    cells = [
        F.avg(F.when(F.col("regime") == r, m.cast("double"))).alias(f"{name}__{r}")
        for name, m in metrics.items()
        for r in regimes
    ]
    wide = panel.groupBy("cascade_id", label, *keep).agg(*cells)
    return wide.dropna(subset=[f"{n}__{r}" for n in metrics for r in regimes])


def wide_panel(panel: DataFrame, metric: Column, regimes: Sequence[str], label: str = "label") -> DataFrame:
    """``replicate_means`` of one metric with the regimes as column names."""
    wide = replicate_means(panel, {"m": metric}, regimes, label)
    return wide.select("cascade_id", label, *[F.col(f"m__{r}").alias(r) for r in regimes])


# Cumulative Poisson(1) probabilities for 0, 1, ... 12 events.
POISSON_STEPS = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(13)])


def _step_bounds() -> np.ndarray:
    """Per step the least whole number whose share of the modulus reaches it."""
    out = []
    for step in POISSON_STEPS:
        h = int(step * _MODULUS) - 2
        while h / float(_MODULUS) < step:
            h += 1
        out.append(h)
    return np.array(out, dtype=np.int64)


_BOUNDS = _step_bounds()
# The weight by the upper 16 of a draw's 31 bits; _MIXED where it depends on the lower ones too.
_MIXED = 255
_CELLS = np.arange(1 << 16, dtype=np.int64) << 15
_BY_CELL = np.where(
    np.searchsorted(_BOUNDS, _CELLS, side="right") == np.searchsorted(_BOUNDS, _CELLS + 32767, side="right"),
    np.searchsorted(_BOUNDS, _CELLS, side="right"), _MIXED,
).astype(np.uint8)
_BLOCK = 32768  # draws at a time, so that a block stays in a core's cache


def _draw_blocks(ids: np.ndarray, replicates: np.ndarray, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks (first replicate's place, whole weights as replicates by ids) of ``poisson_weights``.

    Remainders by 2^31 - 1 are folded: the upper bits are added to the lower 31, and the
    modulus is taken off once if it is reached.
    """
    u = np.uint64
    m = u(_MODULUS)
    a = ((ids.astype(np.int64) % _MODULUS) * 48271 % _MODULUS).astype(u)[None, :]
    b = ((replicates.astype(np.int64) * 1103515245 + seed) % _MODULUS).astype(u)[:, None]
    step = max(1, _BLOCK // max(1, len(ids)))
    for start in range(0, len(replicates), step):
        part = b[start : start + step]
        h = a + part
        t = np.empty_like(h)

        def mod() -> None:
            np.subtract(h, m, out=t)  # below the modulus this wraps to a very large number
            np.minimum(h, t, out=h)

        def mixed(shift: int) -> None:
            np.right_shift(h, u(shift), out=t)
            np.bitwise_xor(h, t, out=h)

        def folded() -> None:
            np.right_shift(h, u(31), out=t)
            np.bitwise_and(h, m, out=h)
            np.add(h, t, out=h)
            mod()

        mod()
        mixed(15)
        np.multiply(h, u(69621), out=h)
        np.add(h, part, out=h)
        folded()
        mixed(13)
        np.multiply(h, u(1103515245), out=h)
        np.add(h, u(12345), out=h)
        folded()
        mixed(16)
        np.right_shift(h, u(15), out=t)
        w = _BY_CELL[t.view(np.int64)]
        at = np.nonzero(w == _MIXED)
        w[at] = np.searchsorted(_BOUNDS, h[at].view(np.int64), side="right")
        yield start, w


def poisson_weights(ids: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) draw for every (id, replicate), a pure function of both and the seed.

    The same cascade gets the same weight under every regime, which pairs the
    contrasts, and a re-run task repeats its draws.
    """
    out = np.empty((len(ids), len(replicates)))
    for start, w in _draw_blocks(ids, replicates, seed):
        out[:, start : start + len(w)] = w.T
    return out


def bootstrap_sums(df: DataFrame, key: str, groups: Sequence[str], values: Sequence[str], n: int, seed: int = K.SEED) -> DataFrame:
    """Weighted counts and sums per (groups, replicate): ``w`` and ``s_<value>``.

    The Poisson bootstrap weighs rows independently, so tasks only exchange sums:
    n rows per group and task, whatever the number of data rows.
    """
    groups = list(groups)
    replicates = np.arange(n)

    def run(frames):
        totals: dict[tuple, np.ndarray] = {}
        for frame in frames:
            for start in range(0, len(frame), 1024):
                piece = frame.iloc[start : start + 1024]
                ids = piece[key].to_numpy()
                x = np.column_stack([np.ones(len(piece)), piece[list(values)].to_numpy(np.float64)])
                codes = piece.groupby(groups, dropna=False, sort=False).indices
                for group, rows in codes.items():
                    group = group if isinstance(group, tuple) else (group,)
                    total = totals.setdefault(group, np.zeros((n, x.shape[1])))
                    mine = x[rows]
                    for first, w in _draw_blocks(ids[rows], replicates, seed):
                        total[first : first + len(w)] += w.astype(np.float64) @ mine
        for group, sums in totals.items():
            out = pd.DataFrame({g: [v] * n for g, v in zip(groups, group)})
            out["replicate"] = replicates
            out["w"] = sums[:, 0]
            for i, v in enumerate(values):
                out[f"s_{v}"] = sums[:, i + 1]
            yield out

    types = dict(df.dtypes)
    schema = ", ".join(
        [f"`{g}` {types[g]}" for g in groups] + ["replicate int", "w double"] + [f"`s_{v}` double" for v in values]
    )
    parts = df.select(key, *groups, *values).mapInPandas(run, schema)
    return parts.groupBy(*groups, "replicate").agg(
        F.sum("w").alias("w"), *[F.sum(f"s_{v}").alias(f"s_{v}") for v in values]
    )


def bootstrap_gaps(wide: DataFrame, values: Sequence[str], n: int = 1000, seed: int = K.SEED,
                   keys: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Per (keys, value): n per class, point gap and its 95% bootstrap interval.

    Long result rows (keys, value, ...); a key lacking a class has a null gap.
    """
    return _summaries(_labelled(wide, label), values, [(v, (None, v)) for v in values], n, seed, keys, label)


def bootstrap_contrasts(wide: DataFrame, pairs: Mapping[str, tuple[str, str]], n: int = 1000, seed: int = K.SEED,
                        keys: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Per (keys, name): gap of the second value minus gap of the first, paired.

    ``pairs`` maps a result name to (baseline value, compared value).
    """
    values = sorted({c for pair in pairs.values() for c in pair})
    wanted = [(name, pair) for name, pair in pairs.items()]
    return _summaries(_labelled(wide, label), values, wanted, n, seed, keys, label)


def _labelled(wide: DataFrame, label: str) -> DataFrame:
    return wide.where(F.col(label).isin(K.LOW, K.HIGH))


def _class_gap(value: str, label: str) -> Column:
    def mean(cls: str) -> Column:
        hit = F.col(label) == cls
        return F.try_divide(F.sum(F.when(hit, F.col(f"s_{value}"))), F.sum(F.when(hit, F.col("w"))))

    return mean(K.LOW) - mean(K.HIGH)


def _summaries(rows, values, wanted, n, seed, keys, label) -> DataFrame:
    keys = list(keys)
    sums = bootstrap_sums(rows, "cascade_id", [*keys, label], values, n, seed)
    point = rows.groupBy(*keys, label).agg(
        F.count(F.lit(1)).cast("double").alias("w"), *[F.sum(v).alias(f"s_{v}") for v in values]
    )

    def cells(extra: Mapping[str, str]) -> Column:
        return F.array(
            *[
                F.struct(
                    F.lit(name).alias("name"),
                    (
                        F.col(f"g_{pair[1]}")
                        if pair[0] is None
                        else F.col(f"g_{pair[1]}") - F.col(f"g_{pair[0]}")
                    ).alias("value"),
                    *[F.col(c).alias(a) for a, c in extra.items()],
                )
                for name, pair in wanted
            ]
        )

    gaps = [_class_gap(v, label).alias(f"g_{v}") for v in values]
    drawn = sums.groupBy(*keys, "replicate").agg(*gaps).select(*keys, F.inline(cells({})))
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    intervals = drawn.groupBy(*keys, "name").agg(q[0].alias("ci_lo"), q[1].alias("ci_hi"))
    actual = point.groupBy(*keys).agg(
        *gaps,
        F.sum(F.when(F.col(label) == K.LOW, F.col("w")).otherwise(0)).cast("long").alias("n_low"),
        F.sum(F.when(F.col(label) == K.HIGH, F.col("w")).otherwise(0)).cast("long").alias("n_high"),
    ).select(*keys, F.inline(cells({"n_low": "n_low", "n_high": "n_high"})))
    return join_on(actual.withColumnRenamed("value", "point"), intervals, [*keys, "name"]).select(
        *keys, "name", "n_low", "n_high", "point", "ci_lo", "ci_hi"
    )


def stage2(panel: DataFrame, metrics: Mapping[str, Column], regimes: Sequence[str], n: int = 1000, baseline: str = "additive",
           seed: int = K.SEED, label: str = "label") -> DataFrame:
    """Gaps of every metric and regime and their contrasts with the baseline, over replicates and by bootstrap.

    Rows (kind, metric, regime, n_low, n_high, point, ci_lo, ci_hi) of four kinds: the mean over
    replicates with the percentiles of its replicates (``gap``, ``contrast``), and those of
    ``stage2_booted``. The panel, many times its seeds, is summed where it is made and never written.
    """
    low, high = F.col(label) == K.LOW, F.col(label) == K.HIGH
    gaps = {m: F.avg(F.when(low, c.cast("double"))) - F.avg(F.when(high, c.cast("double"))) for m, c in metrics.items()}
    per = panel.where(low | high).groupBy("regime", "replicate").agg(
        F.count_if(low).alias("n_low"), F.count_if(high).alias("n_high"), *[g.alias(f"__gap_{m}") for m, g in gaps.items()])
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"__gap_{m}").alias("gap")) for m in metrics])
    per = per.select("regime", "replicate", "n_low", "n_high", F.inline(cells))
    per = stage(per.select(
        "metric", "regime", "replicate", "n_low", "n_high",
        F.when(F.col("gap").isNull(), F.raise_error(F.lit("a replicate lacks a class")).cast("double")).otherwise(F.col("gap")).alias("gap")), "stage2-gaps")

    def over_replicates(kind: str, rows: DataFrame) -> DataFrame:
        q = F.percentile("gap", F.array(F.lit(0.025), F.lit(0.975)))
        return rows.groupBy("metric", "regime").agg(
            F.median("n_low").cast("long").alias("n_low"), F.median("n_high").cast("long").alias("n_high"),
            F.avg("gap").alias("point"), q[0].alias("ci_lo"), q[1].alias("ci_hi")).select(F.lit(kind).alias("kind"), "*")

    base = per.where(F.col("regime") == baseline).select("metric", "replicate", F.col("gap").alias("__base"))
    paired = per.where(F.col("regime") != baseline).join(base, ["metric", "replicate"]).withColumn("gap", F.col("gap") - F.col("__base")).drop("__base")
    booted = stage2_booted(panel, metrics, regimes, n, baseline, seed, label)
    return over_replicates("gap", per).unionByName(over_replicates("contrast", paired)).unionByName(booted)


def stage2_booted(panel: DataFrame, metrics: Mapping[str, Column], regimes: Sequence[str], n: int = 1000, baseline: str = "additive",
                  seed: int = K.SEED, label: str = "label", kinds: Sequence[str] = ("boot_gap", "boot_contrast")) -> DataFrame:
    """The kinds of ``stage2`` that are replicate means with paired bootstrap intervals; all share one matrix of weights."""
    wide = stage(replicate_means(panel.where(F.col(label).isin(K.LOW, K.HIGH)), metrics, regimes, label), "stage2")
    values = [(f"{m}__{r}", m, r) for m in metrics for r in regimes]
    wanted = []
    if "boot_gap" in kinds:
        wanted += [(f"{v}__boot_gap", (None, v)) for v, _, _ in values]
    if "boot_contrast" in kinds:
        wanted += [(f"{v}__boot_contrast", (f"{m}__{baseline}", v)) for v, m, r in values if r != baseline]
    booted = _summaries(wide, [v for v, _, _ in values], wanted, n, seed, (), label)
    name = F.split("name", "__")
    return booted.select(name[2].alias("kind"), name[0].alias("metric"), name[1].alias("regime"), "n_low", "n_high", "point", "ci_lo", "ci_hi")


def bootstrap_mean_difference(df: DataFrame, key: str, side: str, values: Sequence[str], n: int = 1000,
                              seed: int = K.SEED, keys: Sequence[str] = ()) -> DataFrame:
    """Interval of mean(value | side) - mean(value | not side), per key and value."""
    named = df.select(
        F.col(key).alias("cascade_id"), *keys, *values,
        F.when(F.col(side), K.LOW).otherwise(K.HIGH).alias("label"),
    )
    return bootstrap_gaps(named, values, n, seed, keys)


def interval_sign() -> Column:
    """neg, pos or overlaps_0, from ``ci_lo`` and ``ci_hi``."""
    return F.when(F.col("ci_hi") < 0, "neg").when(F.col("ci_lo") > 0, "pos").otherwise("overlaps_0")


def decision(contrasts: DataFrame, main: str = "ablated", control: str = "additive_retuned") -> DataFrame:
    """Outcome letter from the main and control contrasts' intervals.

    A: only the main regime closes the gap. B: the main interval overlaps 0.
    C: both close it. D: the main regime widens it.
    """
    def bound(name: str, column: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col(column)))

    row = contrasts.agg(
        bound(main, "ci_lo").alias("lo"), bound(main, "ci_hi").alias("hi"), bound(control, "ci_hi").alias("control_hi")
    )
    main_neg, main_pos = F.col("hi") < 0, F.col("lo") > 0
    outcome = (
        F.when(F.col("hi").isNull() | F.col("control_hi").isNull(), F.lit(None))
        .when(main_neg & (F.col("control_hi") >= 0), "A")
        .when(~main_neg & ~main_pos, "B")
        .when(main_neg, "C")
        .otherwise("D")
    )
    return row.select(outcome.alias("outcome"), main_neg.alias("main_negative"), main_pos.alias("main_positive"),
                      (F.col("control_hi") < 0).alias("control_negative"))


# ---- truncation ----------------------------------------------------------


def winsorized(wide: DataFrame, caps: Column, values: Sequence[str]) -> DataFrame:
    """One copy of the table per cap with values clipped from above.

    ``caps`` is an array of (quantile, cap) structs, usually a scalar subquery of
    an observed distribution's quantiles.
    """
    rest = [c for c in wide.columns if c not in values]
    capped = wide.withColumn("__caps", caps).select(*rest, *values, F.inline("__caps"))
    return capped.select(
        "quantile", "cap", *rest,
        *[F.least(F.col(v), F.col("cap")).alias(v) for v in values],
        *[(F.col(v) > F.col("cap")).alias(f"clipped_{v}") for v in values],
    )


def clip_counts(clipped: DataFrame, values: Sequence[str], label: str = "label") -> DataFrame:
    """Rows clipped per quantile, value column and class."""
    aggs = [
        F.sum(F.when((F.col(label) == cls) & F.col(f"clipped_{v}"), 1).otherwise(0)).alias(f"{short}__{v}")
        for v in values
        for cls, short in ((K.LOW, "low"), (K.HIGH, "high"))
    ]
    cells = F.array(
        *[
            F.struct(F.lit(v).alias("name"), F.col(f"low__{v}").alias("n_low_clipped"), F.col(f"high__{v}").alias("n_high_clipped"))
            for v in values
        ]
    )
    return clipped.groupBy("quantile", "cap").agg(*aggs).select("quantile", "cap", F.inline(cells))


#: How an interval's sign may move, by the signs before and after; 0 stands for an interval around 0.
_MOVES = {"0,-1": "strengthens", "0,1": "reverses", "-1,0": "weakens", "1,0": "weakens", "-1,1": "reverses", "1,-1": "reverses"}


def shift_verdict(base_lo: Column, base_hi: Column, lo: Column, hi: Column, margin: float = 0.5) -> Column:
    """How a truncated interval moved against the untruncated one: by its signs, else by its nearer end's distance from 0."""
    def sign(a: Column, b: Column) -> Column:
        return F.when(b < 0, "-1").when(a > 0, "1").otherwise("0")

    def distance(a: Column, b: Column) -> Column:
        return F.least(F.abs(a), F.abs(b))

    moves = F.create_map(*[F.lit(x) for pair in _MOVES.items() for x in pair])
    moved = F.try_element_at(moves, F.concat_ws(",", sign(base_lo, base_hi), sign(lo, hi)))
    change = distance(lo, hi) - distance(base_lo, base_hi)
    nearer = F.when(F.abs(change) < margin, "similar").when(change > 0, "further from 0").otherwise("closer to 0")
    return F.coalesce(moved, nearer)


def sweep_summary(table: DataFrame, keys: Sequence[str] = ("metric",)) -> DataFrame:
    """Per metric: points below zero, intervals wholly below zero, extremes."""
    n = F.count(F.lit(1))
    neg = F.sum(F.when(F.col("point") < 0, 1).otherwise(0))
    strict = F.sum(F.when(F.col("ci_hi") < 0, 1).otherwise(0))
    return table.groupBy(*keys).agg(
        n.alias("n_points"), neg.alias("n_negative"), strict.alias("n_strictly_negative"),
        (neg == n).alias("all_negative"), (strict == n).alias("all_strictly_negative"),
        F.min("point").alias("min_point"), F.max("point").alias("max_point"),
    )


def anchor_check(table: DataFrame, value: str, target: float, tolerance: float) -> DataFrame:
    """Is ``value`` of the only row within tolerance of a target? Null-safe."""
    diff = F.abs(F.col(value) - F.lit(target))
    return table.select(
        F.col(value).alias("got"), F.lit(target).alias("target"), diff.alias("abs_diff"),
        F.coalesce(diff <= tolerance, F.lit(False)).alias("matched"),
    )


def max_deviation(df: DataFrame, a: Column, b: Column, tolerance: float) -> DataFrame:
    """Largest absolute difference of two columns; above the tolerance is an error."""
    dev = F.max(F.abs(a - b))
    row = df.agg(dev.alias("max_abs_dev"))
    return row.select(
        F.when(
            F.col("max_abs_dev") > tolerance,
            F.raise_error(F.lit("recomputed values deviate from the stored ones")).cast("double"),
        ).otherwise(F.col("max_abs_dev")).alias("max_abs_dev")
    )
