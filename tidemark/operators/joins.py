"""Joins with the checks the analyses rely on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import first_by


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    """Raise when a key repeats. Stops at the first repeated key found."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        raise ValueError(f"{what}: {list(keys)} is not unique")


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of two tables in which every key occurs once."""
    require_unique(left, keys, "left table")
    require_unique(right, keys, "right table")
    return left.join(right, list(keys))


def lookup(df: DataFrame, table: DataFrame, key: str, order: Sequence[str], required: bool = False) -> DataFrame:
    """Left join on a table reduced to its first row per key.

    ``required``: rows without a match are an error, with their number.
    """
    first = first_by(table, [key], order)
    if required:
        missing = df.join(first, key, "left_anti").count()
        if missing:
            raise ValueError(f"{missing} rows have no match on {key}")
    return df.join(first, key, "left")
