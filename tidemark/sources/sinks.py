"""Result tables on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    """Parquet, CSV with a header or JSON, optionally partitioned (by regime, part...)."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def replace_partition(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions ``df`` has rows for; the others stay as they are."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by).parquet(path)
    )


def splice(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows except those whose key the new rows carry, and the new rows."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)
