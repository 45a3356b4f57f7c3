"""Who does a score form demote? Rank changes against the additive order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.columns import share
from tidemark.functions.scoring import sigmoid
from tidemark.operators.compare import partial_spearman, two_sample
from tidemark.operators.profiles import numeric_profile
from tidemark.operators.ranks import (
    attach_ranks,
    exact_quantiles,
    join_figures,
    ordered_counts,
    quantile_scalars,
    quantiles_of,
)
from tidemark.operators.sampling import level_strata
from tidemark.operators.weightgrid import correlation_with_ranked
from tidemark.session import stage


def demotion_long(df: DataFrame, additive: str, forms: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """Rows (keep, form, form_score, rank_additive, rank_form, demotion).

    Ranks run 0 to 100; demotion is additive minus form, so positive means demoted.
    All forms share one keyed rank job. A column ``rank_additive`` that is there already is kept.
    """
    base = df if "rank_additive" in df.columns else attach_ranks(df, {additive: "rank_additive"}, "percent")
    cells = F.array(
        *[F.struct(F.lit(n).alias("form"), c.alias("form_score")) for n, c in forms.items()]
    )
    long = stage(base.select(*keep, "rank_additive", F.inline(cells)), "forms")
    ranked = attach_ranks(long, {"form_score": "rank_form"}, "percent", ["form"])
    return ranked.withColumn("demotion", F.col("rank_additive") - F.col("rank_form"))


def displacement(df: DataFrame, additive: str, forms: Sequence[str]) -> DataFrame:
    """Unit ranks and regime-minus-additive displacement per form (the opposite sign)."""
    names = {additive: f"rank_{additive}", **{f: f"rank_{f}" for f in forms}}
    ranked = attach_ranks(df, names, "unit")
    return ranked.select(
        "*", *[(F.col(f"rank_{f}") - F.col(f"rank_{additive}")).alias(f"disp_{f}") for f in forms]
    )


def targeting_metrics(long: DataFrame, label: str = "label", fast_share: str = "fast_share", rank: str | None = None) -> DataFrame:
    """Per form: rank correlation of fast share and demotion, make-up of the most demoted
    quarter, mean demotion of the top and bottom tenth of fast share.

    ``rank`` names a column of ``long`` with the rank of fast share among the rows that have one.
    It serves if every form knows the demotion of all of them; else each form ranks its own.
    """
    known = long.where(F.col(fast_share).isNotNull() & F.col("demotion").isNotNull())
    if rank and _all_known(long, known, rank):
        known = known.withColumnRenamed(rank, "rank_share")
    else:
        known = stage(attach_ranks(known, {fast_share: "rank_share"}, "average", ["form"]), "demotion")
    rho = correlation_with_ranked(known, "demotion", "rank_share", ["form"])
    cuts = exact_quantiles(known, "demotion", {"q25": 0.25, "q75": 0.75}, ["form"]).drop("n")
    tails = exact_quantiles(known, fast_share, {"d10": 0.1, "d90": 0.9}, ["form"]).drop("n")
    d, s = F.col("demotion"), F.col(fast_share)
    low = (F.col(label) == K.LOW) & F.col(label).isNotNull()
    top = d >= F.col("q75")
    bottom = d <= F.col("q25")
    stats = join_figures(join_figures(known, cuts, ["form"]), tails, ["form"]).groupBy("form").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(top, F.when(low, 1.0).otherwise(0.0))).alias("top_quarter_low_share"),
        F.avg(F.when(bottom, F.when(low, 1.0).otherwise(0.0))).alias("bottom_quarter_low_share"),
        F.avg(F.when(top, s)).alias("top_quarter_fast_share"),
        F.avg(F.when(bottom, s)).alias("bottom_quarter_fast_share"),
        F.avg(F.when(s >= F.col("d90"), d)).alias("demotion_top_tenth"),
        F.avg(F.when(s <= F.col("d10"), d)).alias("demotion_bottom_tenth"),
    )
    return stats.join(rho, "form")


def _all_known(long: DataFrame, known: DataFrame, rank: str) -> bool:
    """Are the rows of ``known`` the ranked rows of ``long``?"""
    return long.where(F.col(rank).isNotNull()).count() == known.where(F.col(rank).isNotNull()).count() == known.count()


def mean_differences(long: DataFrame, flag: str, value: str = "demotion") -> DataFrame:
    """(form, diff): mean ``value`` of the flagged rows less that of the others."""
    v, f = F.when(~F.isnan(value), F.col(value)), F.col(flag)
    return long.groupBy("form").agg((F.avg(F.when(f, v)) - F.avg(F.when(~f, v))).alias("diff"))


def specificity(long: DataFrame, slow: str = "s_slow", label: str = "label") -> DataFrame:
    """Mean demotion by class among rows in the upper third of slow score, per form."""
    cut = exact_quantiles(long, slow, {"t": 2.0 / 3.0}, ["form"]).drop("n")
    return (
        join_figures(long, cut, ["form"]).where(F.col(slow) >= F.col("t"))
        .where(F.col(label).isin(K.LOW, K.HIGH))
        .groupBy("form", label).agg(F.count(F.lit(1)).alias("n"), F.avg("demotion").alias("mean_demotion"))
    )


def placebo_parameters(df: DataFrame, slow: str = "s_slow", fast: str = "s_fast") -> DataFrame:
    """Fast-gate floor and scale matched in percentile and spread to the slow gate."""
    q = df.agg(share(F.col(slow) <= K.FLOOR).alias("q")).scalar()
    slow_q = quantile_scalars(df, slow, {"lo": 0.25, "hi": 0.75})
    ordered = ordered_counts(df, fast).withColumn("__q", q)
    fast_q = quantiles_of(ordered, fast, {"floor_fast": F.col("__q"), "lo": F.lit(0.25), "hi": F.lit(0.75)})
    iqr_slow = F.col("__s.hi") - F.col("__s.lo")
    iqr_fast = F.col("hi") - F.col("lo")
    return fast_q.withColumn("__s", slow_q).select(
        q.alias("q"), "floor_fast", (F.lit(K.FLOOR_SCALE) * iqr_fast / iqr_slow).alias("scale_fast"),
        iqr_slow.alias("iqr_slow"), iqr_fast.alias("iqr_fast"),
    )


# ---- content gates -------------------------------------------------------


def quality_gate(df: DataFrame, credibility: str, name: str = "gate_quality") -> DataFrame:
    """Add sigmoid((p - median) / population deviation); 0.5 everywhere when that is 0."""
    med = quantile_scalars(df, credibility, {"m": 0.5}).getField("m")
    sd = df.agg(F.stddev_pop(credibility)).scalar()
    z = (F.col(credibility) - F.col("__m")) / F.col("__sd")
    return df.withColumn("__m", med).withColumn("__sd", sd).withColumn(
        name, F.when(F.col("__sd") == 0, F.lit(0.5)).otherwise(sigmoid(z))
    ).drop("__m", "__sd")


def tempered(gate: str, power: float) -> Column:
    return F.pow(F.col(gate), F.lit(float(power)))


def tail_gates(df: DataFrame, gate: str, tails: Sequence[float] = K.TAIL_GRID) -> DataFrame:
    """Add ``tail_<100q>``: gate over its q-quantile up to 1; all ones when that is not positive."""
    cuts = quantile_scalars(df, gate, {f"q{i}": q for i, q in enumerate(tails)})
    out = df.withColumn("__t", cuts)
    for i, q in enumerate(tails):
        tau = F.col(f"__t.q{i}")
        out = out.withColumn(
            f"tail_{round(100 * q)}",
            F.when(tau > 0, F.least(F.lit(1.0), F.col(gate) / tau)).otherwise(F.lit(1.0)),
        )
    return out.drop("__t")


def zscores(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add population z-scores (0 for a constant column): value column -> new name."""
    stats = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(columns)],
        )
    ).scalar()
    out = df.withColumn("__z", stats)
    for i, (c, name) in enumerate(columns.items()):
        sd = F.col(f"__z.s_{i}")
        out = out.withColumn(name, F.when(sd == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"__z.m_{i}")) / sd))
    return out.drop("__z")


def content_forms(gate: str = "gate_quality") -> dict[str, Column]:
    """Score forms that add or multiply content credibility; needs z columns and scores."""
    return {
        "naive_sum": F.col("z_additive") + F.col("z_credibility"),
        "gated": F.col("score_additive") * F.col(gate),
        "combined": F.col("score_reflective_floor") * F.col(gate),
    }


# ---- group views of demotion ---------------------------------------------


def claim_split(long: DataFrame, flag: str, keys: Sequence[str] = ("form",)) -> DataFrame:
    """Demotion where flagged and elsewhere: n, means, difference and U test parts."""
    return two_sample(long, "demotion", flag, keys).select(
        *keys, F.col("n_a").alias("n_flagged"), F.col("n_b").alias("n_other"),
        F.col("mean_a").alias("mean_flagged"), F.col("mean_b").alias("mean_other"),
        (F.col("mean_a") - F.col("mean_b")).alias("diff"), "u", "z_two_sided", "z_greater",
    )


def rank_retention(long: DataFrame, member: Column, rank: str = "rank_form") -> DataFrame:
    """Per form: where the chosen rows end up, and how many stay in the top half and quarter."""
    chosen = long.where(member)
    return chosen.groupBy("form").agg(
        F.count(F.lit(1)).alias("n"), F.avg(rank).alias("mean_final_rank"),
        share(F.col(rank) > 50).alias("share_top_half"), share(F.col(rank) > 75).alias("share_top_quarter"),
    )


def score_gap_closure(df: DataFrame, additive: str, forms: Mapping[str, Column], label: str = "label") -> DataFrame:
    """Low minus high gap of scores scaled to mean 1, and how much of it each form removes."""
    def gap(c: Column) -> Column:
        scaled = F.greatest(F.avg(c), F.lit(K.MULTIPLIER_EPS))
        return (
            F.avg(F.when(F.col(label) == K.LOW, c)) - F.avg(F.when(F.col(label) == K.HIGH, c))
        ) / scaled

    row = df.agg(gap(F.col(additive)).alias("__base"), *[gap(c).alias(f"g_{n}") for n, c in forms.items()])
    cells = F.array(*[F.struct(F.lit(n).alias("form"), F.col(f"g_{n}").alias("gap")) for n in forms])
    return row.select("__base", F.inline(cells)).select(
        "form", "gap", F.col("__base").alias("gap_additive"),
        F.when(F.abs("__base") > K.MULTIPLIER_EPS, (F.col("__base") - F.col("gap")) / F.col("__base")).alias("closure"),
    )


def collateral_split(df: DataFrame, values: Sequence[str], threshold: float = K.DEMOTED_POINTS) -> DataFrame:
    """Distribution of each value among demoted rows and among the rest."""
    flagged = df.withColumn("demoted", F.col("demotion") > threshold)
    return numeric_profile(flagged, values, {"q10": 0.1, "median": 0.5, "q90": 0.9}, ["demoted"]).select(
        "demoted", "metric", "count", "mean", "median", "q10", "q90"
    )


# ---- ratio against level -------------------------------------------------


def ratio_level(df: DataFrame, demotion: str, ratio: str, level: str, keys: Sequence[str] = ()) -> DataFrame:
    """Plain and partial rank correlations of demotion with ratio and level, per key."""
    return partial_spearman(df, demotion, ratio, level, keys).select(
        *keys, "n",
        F.col("rho_xy").alias("rho_demotion_ratio"), F.col("rho_xz").alias("rho_demotion_level"),
        F.col("rho_yz").alias("rho_ratio_level"),
        F.col("partial_xy_z").alias("partial_demotion_ratio"), F.col("partial_xz_y").alias("partial_demotion_level"),
    )


def within_level(df: DataFrame, demotion: str, ratio: str, level: str, bins: int = 5,
                 min_rows: int = K.MIN_STRATUM_ROWS) -> DataFrame:
    """Per level stratum: rank correlation of demotion and ratio, and the contrast of
    mean demotion between the upper and lower third of ratio.

    Strata below ``min_rows`` keep their size and lose their statistics.
    """
    placed = stage(level_strata(df, level, bins), "level-strata")
    ranked = attach_ranks(placed, {ratio: "__rr"}, "average", ["stratum"])
    rho = correlation_with_ranked(ranked, demotion, "__rr", ["stratum"])
    cuts = exact_quantiles(placed, ratio, {"t33": 1.0 / 3.0, "t66": 2.0 / 3.0}, ["stratum"]).drop("n")
    r, d = F.col(ratio), F.col(demotion)
    top, bottom = r >= F.col("t66"), r <= F.col("t33")
    stats = join_figures(placed, cuts, ["stratum"]).groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), F.avg(level).alias("mean_level"), F.avg(d).alias("mean_demotion"),
        F.sum(F.when(top, 1).otherwise(0)).alias("n_top"), F.sum(F.when(bottom, 1).otherwise(0)).alias("n_bottom"),
        F.avg(F.when(top, d)).alias("top_mean"), F.avg(F.when(bottom, d)).alias("bottom_mean"),
    ).join(rho, "stratum").withColumn("top_minus_bottom", F.col("top_mean") - F.col("bottom_mean"))
    enough = F.col("n") >= min_rows
    return stats.select(
        "stratum", "n", (~enough).alias("skipped"),
        *[F.when(enough, F.col(c)).alias(c) for c in (
            "mean_level", "mean_demotion", "rho", "n_top", "n_bottom", "top_mean", "bottom_mean", "top_minus_bottom")],
    )


# ---- verdicts ------------------------------------------------------------


def ratio_branch(low: Column, high: Column) -> Column:
    """Three-way branch on class means of the predicted ratio."""
    close = F.abs(low - high) / F.greatest(high, F.lit(1e-9)) < 0.05
    return (
        F.when(low.isNull() | high.isNull(), "indeterminate")
        .when(low > high, "higher").when(close, "similar").otherwise("lower")
    )


def claim_flags(answer: str) -> dict[str, Column]:
    """A rater's answer as 0/1 columns: each answer, and ``misinfo`` for yes or unclear; an error or no answer is not rated."""
    value = F.upper(F.trim(F.col(answer)))

    def is_one(*answers: str) -> Column:
        return F.coalesce(value.isin(*answers), F.lit(False)).cast("int")

    return {
        "yes": is_one("YES"), "no": is_one("NO"), "unclear": is_one("UNCLEAR"), "misinfo": is_one("YES", "UNCLEAR"),
        "rated": is_one("YES", "NO", "UNCLEAR"), "strict": F.when(value == "YES", 1).when(value == "NO", 0),
    }


def claim_verdict(diff: Column) -> Column:
    """Does the form demote flagged rows more (``diff`` above zero)? Null-safe."""
    return F.when(diff.isNull(), "indeterminate").when(diff > 0, "flagged demoted more").otherwise("not demoted more")


def survival(truncated: DataFrame, keys: Sequence[str] = ("name",), at: str = "quantile") -> DataFrame:
    """Per key, the caps whose interval stays wholly below zero, and those where it no longer does, ascending."""
    below = F.col("ci_hi") < 0

    def caps(hit: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(hit, F.col(at))))  # a cap grid, not data

    return truncated.groupBy(*keys).agg(caps(below).alias("survives"), caps(~F.coalesce(below, F.lit(False))).alias("not_below"))
