"""Structured Streaming versions of ingest, the hourly clock and cascade growth.

State is kept by built-in aggregates on (key, hour), combined before the shuffle,
so a hot conversation is a few counters and not a list of rows. Two forms: with a
watermark, state is bounded, rows beyond it are dropped, and the current table is the
``latest`` version of each group; without one, each micro-batch writes its own partial
counts, which are added when read, so rows of any lateness count and no state is held.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.posts import clean, spread


def read_chunks(spark: SparkSession, folder: str, schema: StructType, per_trigger: int = 1) -> DataFrame:
    """Raw chunk files as a stream, ``per_trigger`` files at a time."""
    return (
        spark.readStream.schema(schema).option("header", True).option("multiLine", True)
        .option("quote", '"').option("escape", '"').option("pathGlobFilter", "*.csv.gz")
        .option("maxFilesPerTrigger", per_trigger).csv(folder)
    )


def read_table_files(spark: SparkSession, folder: str, name: str, schema: StructType, per_trigger: int = 1) -> DataFrame:
    """Files of the table ``folder/name`` as a stream; the table is one file or a folder of part files."""
    # Written as a pattern, the path may be either; without one it must be a folder.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{folder}/{{{name}}}")


def run_to_end(
    stream: DataFrame, out: str, checkpoint: str, mode: str = "append",
    per_batch: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Process what is there and stop; ``per_batch`` is applied to every batch before it is written.

    A batch overwrites its own folder, so a batch run twice leaves one copy.
    """

    def save(batch: DataFrame, number: int) -> None:
        (per_batch(batch) if per_batch else batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .foreachBatch(save).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def latest(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """The newest version of every group an update stream wrote."""
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("batch")).alias("v"))
    return newest.select(*keys, "v.*")


def ingest_stream(raw: DataFrame) -> DataFrame:
    """Cleaned posts from a raw stream: the same parse as in batch.

    A gzip file is read by one task, so its rows are spread before the parse.
    """
    return clean(spread(raw))


def added(spark: SparkSession, out: str, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Partial sums of all batches, added up."""
    return spark.read.parquet(out).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def hourly_counts(events: DataFrame, time: str, kind: str, lateness: str | None = "2 hours") -> DataFrame:
    """Events per tumbling hour and kind.

    Rows later than the watermark are dropped; ``None`` sets none, for one batch's partial counts.
    """
    return (
        (events.withWatermark(time, lateness) if lateness else events)
        .groupBy(F.window(time, "1 hour").alias("w"), kind)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("hour_start"), kind, "n")
    )


def cascade_growth(posts: DataFrame, time: str, conversation: str, engagement: str, lateness: str | None = "365 days") -> DataFrame:
    """Posts and engagement per conversation and clock hour; ``lateness`` as in ``hourly_counts``."""
    return (
        (posts.withWatermark(time, lateness) if lateness else posts)
        .groupBy(conversation, F.window(time, "1 hour").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(engagement).alias("engagement"))
        .select(conversation, F.col("w.start").alias("hour_start"), "n", "engagement")
    )


def cascade_totals(hours: DataFrame, conversation: str) -> DataFrame:
    """Running size, engagement and peak hour of every conversation."""
    return hours.groupBy(conversation).agg(
        F.sum("n").alias("n_posts"), F.sum("engagement").alias("engagement"),
        F.max_by("hour_start", F.struct(F.col("n"), -F.unix_timestamp("hour_start"))).alias("peak_hour"),
    )
