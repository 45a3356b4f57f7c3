"""Facts about few of many rows, brought to them without shuffling the rest.

A bit filter of the facts' keys is broadcast. Rows that it lets through meet the facts in
a join, with all their columns; every other row surely has no fact and stays where it is.
The filter has 16 bits a key up to ``MOST_BITS``; beyond that it lets more rows through
and the join still decides, so results are exact whatever its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textbytes import mix

LEAST_BITS, MOST_BITS = 1 << 18, 1 << 26


class BitFilter:
    """Which of many longs are surely not among the keys it was made of."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        bit = _bits(keys, 64 * len(self.table))
        return (self.table[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _bits(keys: np.ndarray, size: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) % np.uint64(size)).astype(np.int64)


def bit_filter(keys: DataFrame):
    """A broadcast ``BitFilter`` table of the first column of ``keys``, longs without nulls; at most 8 MB."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << int(16 * keys.count()).bit_length()))
    name = keys.columns[0]

    def mark(batches):
        for batch in batches:
            bit = _bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bit >> 6), pa.array((np.uint64(1) << (bit & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    found = keys.select(F.col(name).cast("long").alias("k")).mapInArrow(mark, "word long, bits long")
    words = found.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()  # at most MOST_BITS / 64 rows
    table = np.zeros(size // 64, np.uint64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(table)


def let_through(shared) -> callable:
    """A function from a column of longs to whether the filter lets each through; only that column leaves the JVM."""

    @F.arrow_udf("boolean")
    def may(keys: pa.Array) -> pa.Array:
        return pa.array(BitFilter(shared.value).may_hold(keys.to_numpy(zero_copy_only=False).astype(np.int64)))

    return may


def row_key(columns: list[str], seed: int) -> Column:
    """64 bits of a whole row; nulls count with their place. Two seeds give 128."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(c), F.col(c).isNull())])


def split(rows: DataFrame, key: str, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` that surely have no fact, and those that may; ``facts`` holds its keys in its column ``key``."""
    may = let_through(bit_filter(facts.select(key)))
    flagged = rows.withColumn("_may", may(F.col(key)))
    return flagged.where(~F.col("_may")).drop("_may"), flagged.where("_may").drop("_may")
