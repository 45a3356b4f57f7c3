"""Exact top-k inner products by vector-approximation files.

Rows and queries are dealt by hash into blocks of bounded size, and every block of rows
meets every block of queries once. There the rows' components are cut into cells; one
matrix product over the cells bounds every score from both sides. The kth largest lower
bound discards nearly all rows, and the exact vectors of the rest are read in order of
their upper bounds until no unread one can enter or tie the best k. The k best of each
block meet in a ranking per query that keeps k rows before its shuffle too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.vectors import matrix, usable
from tidemark.session import ship_package

ROWS, QUERIES, CELLS, READ = 8192, 1024, 64, 64


def _scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact whole-number inner products, held within 64 bits."""
    if np.abs(rows).max(initial=0) * np.abs(query).max(initial=0) * rows.shape[1] < 2.0**53:
        return (rows @ query).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, query)) for row in rows]
    return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in exact], np.int64)


class ApproximationFile:
    """Rows' components cut into at most ``cells`` equal cells, one byte each."""

    def __init__(self, rows: np.ndarray, cells: int = CELLS) -> None:
        low, high = (rows.min(), rows.max()) if rows.size else (0.0, 0.0)
        self.low, self.width = low, max(1.0, np.ceil((high - low + 1) / cells))
        self.cells = np.minimum((rows - low) // self.width, 255).astype(np.uint8)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible score of every (query, row)."""
        base = queries @ (self.cells.astype(np.float64) * self.width + self.low).T
        slack = np.abs(base) * 1e-9 + 1e-6  # of rounding
        return (
            base + (self.width * np.minimum(queries, 0).sum(1))[:, None] - slack,
            base + (self.width * np.maximum(queries, 0).sum(1))[:, None] + slack,
        )


def block_top_k(ids, rows, query_ids, queries, k: int):
    """(query, row id, score) of the best k rows of the block for each query, other than rows of its own id."""
    out, file = [], ApproximationFile(rows)
    for lo in range(0, len(queries), 64):
        lower, upper = file.bounds(queries[lo : lo + 64])
        for i, own in enumerate(query_ids[lo : lo + 64]):
            other = ids != own
            low, up = lower[i][other], upper[i][other]
            n = len(low)
            floor = np.partition(low, n - k)[n - k] if n > k else -np.inf
            found = np.flatnonzero(up >= floor)
            found = found[np.argsort(-up[found], kind="stable")]
            at = np.flatnonzero(other)[found]
            best_id, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for start in range(0, len(at), READ):
                if len(best) == k and up[found[start]] < best[-1]:
                    break
                some = at[start : start + READ]
                best = np.concatenate([best, _scores(rows[some], queries[lo + i])])
                best_id = np.concatenate([best_id, ids[some]])
                order = np.lexsort((best_id, -best))[:k]
                best, best_id = best[order], best_id[order]
            out += [(own, a, b) for a, b in zip(best_id.tolist(), best.tolist())]
    return out


def top_k(vectors: DataFrame, is_query: str, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
          rows_per_block: int = ROWS, queries_per_block: int = QUERIES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest scores of each row that the SQL condition ``is_query`` names.

    Components become floor(scale * x). Rows with a null id, a null vector, or null or
    non-finite components take no part; missing components count as zero. Ties go to the
    smaller id; fewer than k candidates give fewer rows; rows of the query's own id are no
    candidates. Repeated rows are candidates each.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    queries = rows.where(is_query)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))
    queries = queries.select(F.col(id_col).cast("long").alias("id"), whole.alias("v")).distinct()
    n_rows = max(1, -(-rows.count() // rows_per_block))
    n_queries = max(1, -(-queries.count() // queries_per_block))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def block(n: int):
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    met = rows.select("id", "v", F.lit(False).alias("asks"), block(n_rows).alias("r"), every(n_queries).alias("q")).union(
        queries.select("id", "v", F.lit(True).alias("asks"), every(n_rows).alias("r"), block(n_queries).alias("q")))

    def run(table: pa.Table) -> pa.Table:
        asks = np.array(table.column("asks").to_pylist(), bool)
        ids = np.array(table.column("id").to_pylist(), np.int64)
        v = matrix(table.column("v"), np.float64)
        found = block_top_k(ids[~asks], v[~asks], ids[asks].tolist(), v[asks], k) if asks.any() and not asks.all() else []
        return pa.table({c: pa.array([f[i] for f in found], pa.int64()) for i, c in enumerate(("query_id", "vec_id", "score"))})

    best = met.groupBy("r", "q").applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
