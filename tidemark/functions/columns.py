"""Small Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_or_zero(name: str) -> Column:
    """A count read from text or number: unreadable, NaN and null become 0."""
    return F.coalesce(
        F.nanvl(F.col(name).try_cast("double"), F.lit(None).cast("double")), F.lit(0.0)
    )


def flag_or_false(name: str) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False))


def no_nan(name: str) -> Column:
    """NaN as null, so that both leave every group and rank."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def share(condition: Column) -> Column:
    """Share of rows for which ``condition`` holds; null counts as false."""
    return F.avg(F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0)))


def safe_ratio(num: Column, den: Column, eps: float = 1.0) -> Column:
    return num / (den + F.lit(float(eps)))


def interval_bucket(value: Column, edges: Column, closed: str) -> Column:
    """Index of the interval of sorted ``edges`` that holds ``value``.

    ``left``: [e_i, e_i+1), last closed, outside values and nulls clipped to the
    first or last interval. ``right``: (e_i, e_i+1], the first closed on both
    sides, outside values and nulls give null.
    """
    last = F.size(edges) - F.lit(2)
    if closed == "left":
        hits = F.size(F.filter(edges, lambda e: e <= value)) - F.lit(1)
        inner = F.least(F.greatest(hits, F.lit(0)), last)
        return F.when(last < 0, F.lit(0)).when(value.isNull(), last).otherwise(inner)
    if closed == "right":
        below = F.size(F.filter(edges, lambda e: e < value)) - F.lit(1)
        inside = (value >= F.element_at(edges, 1)) & (value <= F.element_at(edges, -1))
        return F.when(inside, F.greatest(below, F.lit(0)))
    raise ValueError(f"closed must be left or right, not {closed!r}")


def equal_width_bucket(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Zero-based bin of ``bins`` equal widths; the top edge falls in the last bin."""
    width = (hi - lo) / F.lit(float(bins))
    raw = F.floor((value - lo) / width).cast("int")
    return F.when(hi > lo, F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))).otherwise(F.lit(0))


def literal_doubles(values: Sequence[float]) -> Column:
    """A constant array<double>, parsed once instead of one call per element."""
    return F.expr("array(" + ",".join(f"{float(v)!r}D" for v in values) + ")")
