"""Two-sample tests, rank correlation, agreement and classification measures.

All of them read the ordered value counts of ``ranks``; none sorts a whole group
in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions import pvalues
from tidemark.operators.contrasts import bootstrap_mean_difference
from tidemark.operators.ranks import attach_ranks, average_rank, ordered_counts, quantile_parts, unpivot
from tidemark.session import stage


def _sides(side: str) -> dict[str, Column]:
    in_a = F.col(side).cast("boolean")
    return {
        "a": F.sum(F.when(in_a, 1).otherwise(0)),
        "b": F.sum(F.when(in_a, 0).otherwise(1)),
        "n": F.count(F.lit(1)),
    }


def two_sample(df: DataFrame, value: str, side: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per key comparing ``value`` where ``side`` is true (a) and false (b).

    Counts, means, medians, 90th percentiles, the Kolmogorov-Smirnov distance,
    Mann-Whitney U of the first sample, the tie-corrected normal score with
    continuity correction, and ROC area (U / n_a n_b). Statistics are null when a
    sample is empty.
    """
    keys = list(keys)
    ordered = ordered_counts(df, value, keys, _sides(side))
    v, a, b, n = F.col(value), F.col("a"), F.col("b"), F.col("n")
    qa, qa_cols = quantile_parts(value, {"median_a": 0.5, "p90_a": 0.9}, "a")
    qb, qb_cols = quantile_parts(value, {"median_b": 0.5, "p90_b": 0.9}, "b")
    nd = n.cast("double")
    parts = ordered.groupBy(*keys).agg(
        F.max("tot_a").alias("n_a"),
        F.max("tot_b").alias("n_b"),
        F.sum(v * a).alias("__sum_a"),
        F.sum(v * b).alias("__sum_b"),
        F.max(
            F.abs(
                F.try_divide(F.col("cum_a"), F.col("tot_a"))
                - F.try_divide(F.col("cum_b"), F.col("tot_b"))
            )
        ).alias("ks"),
        F.sum(a * average_rank()).alias("__rank_a"),
        F.sum(nd * nd * nd - nd).alias("__ties"),
        *qa,
        *qb,
    )
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    both = (na > 0) & (nb > 0)
    u = F.when(both, F.col("__rank_a") - na * (na + 1) / 2)
    total = na + nb
    spread = F.sqrt(na * nb / 12 * (total + 1 - F.try_divide(F.col("__ties"), total * (total - 1))))
    return parts.select(
        *keys,
        "n_a",
        "n_b",
        F.try_divide(F.col("__sum_a"), na).alias("mean_a"),
        F.try_divide(F.col("__sum_b"), nb).alias("mean_b"),
        *qa_cols,
        *qb_cols,
        "ks",
        u.alias("u"),
        F.try_divide(u, na * nb).alias("auc"),
        F.try_divide(F.abs(u - na * nb / 2) - F.lit(0.5), spread).alias("z_two_sided"),
        F.try_divide(u - na * nb / 2 - F.lit(0.5), spread).alias("z_greater"),
    )


def with_p_values(tests: DataFrame) -> DataFrame:
    """Add KS and Mann-Whitney p-values to ``two_sample`` rows."""
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    return tests.select(
        "*",
        pvalues.kolmogorov_upper(F.col("ks"), na, nb).alias("ks_p"),
        F.least(F.lit(1.0), F.lit(2.0) * pvalues.normal_upper(F.col("z_two_sided"))).alias("mw_p"),
        pvalues.normal_upper(F.col("z_greater")).alias("mw_p_greater"),
    )


def spearman(
    df: DataFrame, x: str, y: str, keys: Sequence[str] = (), p_value: bool = False
) -> DataFrame:
    """Rank correlation per key; optionally its t-based p-value with n - 2."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = attach_ranks(both, {x: "__rx", y: "__ry"}, "average", keys)
    out = ranked.groupBy(*keys).agg(
        F.corr("__rx", "__ry").alias("rho"), F.count(F.lit(1)).alias("n")
    )
    if p_value:
        out = out.withColumn("p_value", pvalues.correlation_p(F.col("rho"), F.col("n") - 2))
    return out


def partial_from(rxy: Column, rxz: Column, ryz: Column) -> Column:
    """Correlation of x and y given z; null when z determines either."""
    room = (F.lit(1.0) - rxz * rxz) * (F.lit(1.0) - ryz * ryz)
    return F.when(room > 0, (rxy - rxz * ryz) / F.sqrt(room))


def partial_spearman(
    df: DataFrame, x: str, y: str, z: str, keys: Sequence[str] = (), p_value: bool = False
) -> DataFrame:
    """Partial rank correlation of x and y given z, with the three plain ones."""
    ranked = attach_ranks(df, {x: "__rx", y: "__ry", z: "__rz"}, "average", keys)
    out = ranked.groupBy(*keys).agg(
        F.corr("__rx", "__ry").alias("rho_xy"),
        F.corr("__rx", "__rz").alias("rho_xz"),
        F.corr("__ry", "__rz").alias("rho_yz"),
        F.count(F.lit(1)).alias("n"),
    )
    out = out.select(
        "*",
        partial_from(F.col("rho_xy"), F.col("rho_xz"), F.col("rho_yz")).alias("partial_xy_z"),
        partial_from(F.col("rho_xz"), F.col("rho_xy"), F.col("rho_yz")).alias("partial_xz_y"),
    )
    if p_value:
        for name in ("partial_xy_z", "partial_xz_y"):
            out = out.withColumn(f"p_{name}", pvalues.correlation_p(F.col(name), F.col("n") - 3))
    return out


def roc_auc(df: DataFrame, score: str, positive: str, keys: Sequence[str] = ()) -> DataFrame:
    """ROC area by rank sums; null when only one class is present."""
    return two_sample(df, score, positive, keys).select(
        *keys, F.col("n_a").alias("n_pos"), F.col("n_b").alias("n_neg"), "auc"
    )


def threshold_curve(df: DataFrame, score: str, positive: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score: precision, recall, false-positive rate at or above it."""
    ordered = ordered_counts(df, score, keys, _sides(positive))
    tp = F.col("tot_a") - F.col("cum_a") + F.col("a")
    fp = F.col("tot_b") - F.col("cum_b") + F.col("b")
    return ordered.select(
        *keys,
        F.col(score).alias("threshold"),
        tp.alias("tp"),
        fp.alias("fp"),
        (tp / (tp + fp)).alias("precision"),
        F.try_divide(tp, F.col("tot_a")).alias("recall"),
        F.try_divide(fp, F.col("tot_b")).alias("fpr"),
        F.try_divide(F.col("a"), F.col("tot_a")).alias("recall_step"),
    )


def average_precision(df: DataFrame, score: str, positive: str, keys: Sequence[str] = ()) -> DataFrame:
    """Sum over thresholds of recall step times precision."""
    return threshold_curve(df, score, positive, keys).groupBy(*keys).agg(
        F.sum(F.col("recall_step") * F.col("precision")).alias("average_precision"),
        F.max("tp").alias("n_pos"),
    )


def ecdf(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct values with the share of rows at or below each."""
    return ordered_counts(df, value, keys).select(
        *keys, value, (F.col("cum_n") / F.col("tot_n")).alias("share_at_or_below")
    )


def contingency(df: DataFrame, first: str, second: str) -> DataFrame:
    """Counts over pairs of two raters' categories; rows lacking either are left out."""
    rated = df.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    return rated.groupBy(
        F.col(first).cast("string").alias("first"), F.col(second).cast("string").alias("second")
    ).agg(F.count(F.lit(1)).alias("n"))


def cohen_kappa(df: DataFrame, first: str, second: str) -> DataFrame:
    """Raw agreement, chance agreement and kappa (null when chance is 1 or no rows)."""
    cells = contingency(df, first, second)
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("first").alias("category"),
                    F.col("n").alias("n1"),
                    F.lit(0).cast("long").alias("n2"),
                    F.when(F.col("first") == F.col("second"), F.col("n")).otherwise(0).alias("same"),
                ),
                F.struct(
                    F.col("second").alias("category"),
                    F.lit(0).cast("long").alias("n1"),
                    F.col("n").alias("n2"),
                    F.lit(0).cast("long").alias("same"),
                ),
            )
        )
    )
    margins = sides.groupBy("category").agg(
        F.sum("n1").alias("n1"), F.sum("n2").alias("n2"), F.sum("same").alias("same")
    )
    total = margins.agg(
        F.sum("n1").alias("n"),
        F.sum("same").alias("same"),
        F.sum(F.col("n1").cast("double") * F.col("n2")).alias("products"),
    )
    po = F.try_divide(F.col("same"), F.col("n"))
    pe = F.try_divide(F.col("products"), F.col("n").cast("double") * F.col("n"))
    return total.select(
        F.coalesce("n", F.lit(0)).alias("n"),
        po.alias("agreement"),
        pe.alias("chance"),
        F.when(pe < 1, (po - pe) / (F.lit(1.0) - pe)).alias("kappa"),
    )


def input_separability(df: DataFrame, inputs: Sequence[str], flag: str) -> DataFrame:
    """Per input column: mean where flagged, mean elsewhere, difference, U test parts."""
    from tidemark.operators.ranks import unpivot

    long = unpivot(df, inputs, [flag], "input")
    return two_sample(long, "value", flag, ["input"]).select(
        "input",
        "n_a",
        "n_b",
        F.col("mean_a").alias("mean_flagged"),
        F.col("mean_b").alias("mean_other"),
        (F.col("mean_a") - F.col("mean_b")).alias("diff"),
        "u",
        "ks",
        "z_two_sided",
        "z_greater",
    )


def note_flags(notes: DataFrame, key: str, flags: Mapping[str, Column]) -> DataFrame:
    """One row per noted post: ``n_notes`` and, per flag, whether any note sets it. Notes without a key are out."""
    return notes.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_notes"), *[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in flags.items()])


def compare_arms(rows: DataFrame, key: str, values: Sequence[str], comparisons: Mapping[str, tuple[Column, Column]],
                 n: int = 1000, seed: int = K.SEED) -> DataFrame:
    """Two-sample statistics and a bootstrap interval of the mean difference, per comparison and value.

    ``comparisons`` maps a name to (is a case, is a control) over ``rows``; a row may serve in
    several. One pass makes its memberships, one keyed job each the ranks and the draws; a row
    has the same weight in every comparison. Columns: comparison, metric, those of
    ``two_sample``, diff, ci_lo, ci_hi.
    """
    cells = F.array(*[
        F.when(case | control, F.struct(F.lit(name).alias("comparison"), F.coalesce(case, F.lit(False)).alias("side")))
        for name, (case, control) in ((k, (F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False)))) for k, (a, b) in comparisons.items())
    ])
    arms = stage(rows.select(key, *values, F.inline(F.filter(cells, lambda c: c.isNotNull()))), "arms")
    stats = two_sample(unpivot(arms, values, ["comparison", "side"]), "value", "side", ["comparison", "metric"])
    drawn = bootstrap_mean_difference(arms, key, "side", values, n, seed, ["comparison"])
    drawn = drawn.select("comparison", F.col("name").alias("metric"), F.col("point").alias("diff"), "ci_lo", "ci_hi")
    return stats.join(drawn, ["comparison", "metric"])
