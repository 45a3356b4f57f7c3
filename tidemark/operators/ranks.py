"""Ranks, running totals and exact quantiles over a whole table.

A window without partition keys would sort the table in one task. Here equal
values are first summed (so a value shared by a third of the rows is one row),
then a range exchange deals the distinct values, in order, to as many tasks as their
number asks for, and each range adds the totals of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import no_nan
from tidemark.session import stage

ROWS_PER_RANGE = 1_000_000
_MAX_KEYS = 1000


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with null equal to null, so groups without a key stay; the left side's keys are kept.

    Without keys ``right`` is the one row of a whole-table aggregate.
    """
    keys = list(keys)
    if not keys:
        return left.crossJoin(right)
    named = right.select(*[F.col(f"`{c}`").alias(f"__on_{c}" if c in keys else c) for c in right.columns])
    same = F.lit(True)
    for c in keys:
        same = same & left[c].eqNullSafe(named[f"__on_{c}"])
    return left.join(named, same, how).drop(*[f"__on_{c}" for c in keys])


def join_figures(df: DataFrame, figures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the figures of their key, a table of one row per key such as medians per regime.

    The figures are written first. By its estimates of what is not written yet the planner may
    send the many rows of ``df`` to the driver as the smaller side, or shuffle them into as many
    tasks as there are keys; up to ``_MAX_KEYS`` counted figures are broadcast instead.
    """
    figures = stage(figures, "figures")
    few = figures.count() <= _MAX_KEYS
    return df.join(F.broadcast(figures) if few else figures, list(keys))


def fits_one_task(df: DataFrame) -> bool:
    """Is the table counted small enough for a plain window?"""
    return df.count() <= ROWS_PER_RANGE


def ordered_counts(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    measures: Mapping[str, Column] | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Distinct values in order with, per measure, its sum, running sum and total.

    Columns: keys, ``value``, then ``m``, ``cum_m`` (this value included) and
    ``tot_m`` for each measure ``m`` (default: the row count ``n``). ``small`` says
    whether the table fits one task; it is counted otherwise. A larger table's distinct
    values are written in ranges, one for every ``ROWS_PER_RANGE`` of them.
    """
    measures = dict(measures or {"n": F.count(F.lit(1))})
    keys = list(keys)
    src = df.withColumn(value, no_nan(value)).where(F.col(value).isNotNull())
    small = fits_one_task(src) if small is None else small
    counted = src.groupBy(*keys, value).agg(*[m.alias(n) for n, m in measures.items()])
    group = keys or [F.lit(1)]
    pieces = 1
    if not small:
        # Written first: finding the ranges reads the values once more.
        counted = stage(counted, "distinct-values")
        pieces = -(-counted.count() // ROWS_PER_RANGE)
    if pieces <= 1:
        running = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*group)
        return counted.select(
            "*",
            *[F.sum(n).over(running).alias(f"cum_{n}") for n in measures],
            *[F.sum(n).over(whole).alias(f"tot_{n}") for n in measures],
        )
    # The keys too: many of them may share one value.
    ranged = counted.repartitionByRange(pieces, value, *keys).withColumn("__range", F.spark_partition_id())
    ranged = stage(ranged, "value-ranges")
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    totals = (
        ranged.groupBy(*keys, "__range")
        .agg(*[F.sum(n).alias(f"__sum_{n}") for n in measures])
        .select(
            *keys,
            "__range",
            *[F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n in measures],
            *[F.sum(f"__sum_{n}").over(whole).alias(f"tot_{n}") for n in measures],
        )
    )
    inside = (
        Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        join_on(ranged, totals, [*keys, "__range"])
        .select(
            *keys,
            value,
            *measures,
            *[(F.sum(n).over(inside) + F.col(f"__before_{n}")).alias(f"cum_{n}") for n in measures],
            *[f"tot_{n}" for n in measures],
        )
    )


def average_rank(cum: Column | None = None, n: Column | None = None, total: Column | None = None) -> Column:
    """Mean 1-based rank of a value; by default over ``ordered_counts`` columns."""
    cum = F.col("cum_n") if cum is None else cum
    n = F.col("n") if n is None else n
    return cum - (n - 1) / F.lit(2.0)


def unit_rank(cum: Column | None = None, n: Column | None = None, total: Column | None = None) -> Column:
    """Average rank over n, in (0, 1]."""
    return average_rank(cum, n) / (F.col("tot_n") if total is None else total)


def percent_rank(cum: Column | None = None, n: Column | None = None, total: Column | None = None) -> Column:
    """100 * (average rank - 1) / (n - 1), in [0, 100]; 0 for a single row."""
    total = F.col("tot_n") if total is None else total
    scaled = F.lit(100.0) * (average_rank(cum, n) - F.lit(1.0)) / (total - 1)
    return F.when(total > 1, scaled).otherwise(F.lit(0.0))


RANKS = {"average": average_rank, "unit": unit_rank, "percent": percent_rank}


def attach_ranks(
    df: DataFrame, columns: Mapping[str, str], kind: str = "average", keys: Sequence[str] = ()
) -> DataFrame:
    """Add rank columns: ``columns`` maps a value column to the name of its rank.

    A table counted small enough for one task is ranked by plain windows. Beyond
    that the rank table has one row per distinct value, and the join back is an
    equi-join that adaptive execution broadcasts or splits when a value is hot.
    """
    small = fits_one_task(df)
    out = df
    for value, name in columns.items():
        if not small:
            table = ordered_counts(df, value, keys, small=False).select(
                *keys, F.col(value).alias("__value"), RANKS[kind]().alias(name)
            )
            out = join_on(out.withColumn("__value", no_nan(value)), table, [*keys, "__value"], "left").drop("__value")
        else:
            out = _window_rank(out, value, name, kind, keys)
    return out


def _window_rank(df: DataFrame, value: str, name: str, kind: str, keys: Sequence[str]) -> DataFrame:
    """Ranks of a table known to fit in one task; nulls stay apart and get none."""
    part = [*keys, F.col("__value").isNull()]
    upto = Window.partitionBy(*part).orderBy("__value").rangeBetween(Window.unboundedPreceding, 0)
    ranked = df.withColumn("__value", no_nan(value)).select(
        "*",
        F.count(F.lit(1)).over(upto).alias("__cum"),
        F.rank().over(Window.partitionBy(*part).orderBy("__value")).alias("__first"),
        F.count(F.lit(1)).over(Window.partitionBy(*part)).alias("__total"),
    )
    rank = RANKS[kind](F.col("__cum"), F.col("__cum") - F.col("__first") + 1, F.col("__total"))
    return ranked.select(*df.columns, F.when(F.col("__value").isNotNull(), rank).alias(name))


def quantile_parts(
    value: str, probes: Mapping[str, float | Column], measure: str = "n"
) -> tuple[list[Column], list[Column]]:
    """Aggregates over an ``ordered_counts`` table, and the quantiles made from them.

    A quantile interpolates between two order statistics; each is the smallest
    value whose running count passes its position.
    """
    parts, made = [], []
    for name, p in probes.items():
        h = (F.col(f"tot_{measure}") - 1) * (F.lit(float(p)) if isinstance(p, (int, float)) else p)
        lo, hi = F.floor(h), F.ceil(h)
        passed = F.col(f"cum_{measure}")
        parts += [
            F.min(F.when(passed > lo, F.col(value))).alias(f"__lo_{name}"),
            F.min(F.when(passed > hi, F.col(value))).alias(f"__hi_{name}"),
            F.max(h - lo).alias(f"__frac_{name}"),
        ]
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        made.append((low + (high - low) * F.col(f"__frac_{name}")).alias(name))
    return parts, made


def quantiles_of(
    ordered: DataFrame, value: str, probes: Mapping[str, float | Column], keys: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolation quantiles per key from an ``ordered_counts`` table."""
    parts, made = quantile_parts(value, probes)
    out = ordered.groupBy(*keys).agg(F.max("tot_n").alias("n"), *parts)
    return out.select(*keys, "n", *made)


def exact_quantiles(
    df: DataFrame, value: str, probes: Mapping[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles per key: columns keys, ``n`` and one per probe.

    ``percentile`` holds a group's values in one task, so it only serves tables
    counted small enough for that. Larger tables are not sorted either: an
    approximate pass brackets each quantile, a second pass counts the rows below
    the bracket and keeps only the few inside, where the order statistics lie.
    """
    keys, names = list(keys), list(probes)
    known = df.select(*keys, no_nan(value).alias("__v")).where(F.col("__v").isNotNull())
    accuracy = 10_000
    near = [_clip(p + s * 4.0 / accuracy) for p in probes.values() for s in (-1, 1)]
    found = (
        known.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("__v").alias("min"), F.max("__v").alias("max"),
            F.expr(f"percentile_approx(__v, array({','.join(f'{p!r}D' for p in near)}), {accuracy})").alias("near"),
        )
        .limit(_MAX_KEYS + 1)
        .collect()
    )
    if len(found) > _MAX_KEYS:
        return quantiles_of(ordered_counts(df, value, keys), value, probes, keys)
    if sum(r["n"] for r in found) <= ROWS_PER_RANGE:
        q = F.percentile("__v", F.array(*[F.lit(float(p)) for p in probes.values()]))
        out = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), q.alias("__q"))
        return out.select(*keys, "n", *[F.col("__q")[i].alias(name) for i, name in enumerate(names)])
    brackets = []
    for r in found:
        for i, p in enumerate(probes.values()):
            lo = r["min"] if near[2 * i] <= 0.0 else r["near"][2 * i]
            hi = r["max"] if near[2 * i + 1] >= 1.0 else r["near"][2 * i + 1]
            brackets.append((*[r[k] for k in keys], i, p, r["n"], lo, hi))
    return _between(known, brackets, keys, names)


def _clip(p: float) -> float:
    return min(max(p, 0.0), 1.0)


def _between(known: DataFrame, brackets: list[tuple], keys: list[str], names: list[str]) -> DataFrame:
    """Order statistics inside known brackets; a bracket that misses is an error."""
    types = dict(known.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["__i int", "__p double", "__n long", "__lo double", "__hi double"])
    table = known.sparkSession.createDataFrame(brackets, schema)
    cells = table.groupBy(*keys).agg(F.collect_list(F.struct("__i", "__p", "__n", "__lo", "__hi")).alias("__b"))
    if keys:
        same = F.lit(True)
        for k in keys:
            same = same & known[k].eqNullSafe(cells[k])
        # At most _MAX_KEYS rows, counted above.
        rows = known.join(F.broadcast(cells), same).select(*[known[k] for k in keys], "__v", F.inline("__b"))
    else:
        rows = known.withColumn("__b", cells.select("__b").scalar()).select("__v", F.inline("__b"))
    group = [*keys, "__i"]
    close = F.when(F.col("__v") < F.col("__lo"), F.lit(float("-inf"))).when(F.col("__v") <= F.col("__hi"), F.col("__v"))
    counted = (
        rows.withColumn("__x", close).where(F.col("__x").isNotNull())
        .groupBy(*group, "__p", "__n", "__x").agg(F.count(F.lit(1)).alias("c"))
    )
    running = Window.partitionBy(*group).orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("cum", F.sum("c").over(running))
    h = (F.col("__n") - 1) * F.col("__p")
    at = placed.groupBy(*group).agg(
        F.max("__n").alias("n"),
        F.max(h - F.floor(h)).alias("frac"),
        F.min(F.when(F.col("cum") > F.floor(h), F.col("__x"))).alias("lo"),
        F.min(F.when(F.col("cum") > F.ceil(h), F.col("__x"))).alias("hi"),
    )
    missed = F.col("lo").isNull() | F.col("hi").isNull() | (F.col("lo") == float("-inf"))
    q = F.when(missed, F.raise_error(F.lit("a quantile bracket missed")).cast("double")).otherwise(
        F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("frac")
    )
    per = at.withColumn("q", q).groupBy(*keys).agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("__i") == i, F.col("q"))).alias(name) for i, name in enumerate(names)]
    )
    return per


def quantile_scalars(df: DataFrame, value: str, probes: Mapping[str, float]) -> Column:
    """The quantiles of one column as a scalar subquery struct."""
    return exact_quantiles(df, value, probes).select(F.struct(*probes).alias("q")).scalar()


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), name: str = "metric") -> DataFrame:
    """Long form (keep..., ``name``, value), so that one job serves many columns."""
    cells = [F.struct(F.lit(c).alias(name), no_nan(c).alias("value")) for c in columns]
    return df.select(*keep, F.inline(F.array(*cells)))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Distinct first row per key in an explicit total order, combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    )
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def top_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows in order: each task keeps its own n before the merge."""
    return df.orderBy(*order).limit(n)
