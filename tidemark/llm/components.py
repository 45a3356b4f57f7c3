"""Connected components of an edge table, smallest id as the component's name.

Every Arrow batch is first contracted by a union-find of its own, so a dense group
shrinks to a spanning forest before anything is shuffled. Then large-star and
small-star rounds alternate (Kiveris et al., 2014): minima are partially aggregated, a
hub's neighbours meet its minimum in a join that adaptive execution may split, and each
round is written to the shared folder. Rounds grow with the logarithm of the longest
path. Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x], x = root, p
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def edges(self) -> tuple[list[int], list[int]]:
        return list(self.up), [self.find(x) for x in list(self.up)]


def _contract(batches):
    for batch in batches:
        forest = Forest()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in forest.edges()], ["hi", "lo"])


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    low = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("m", "hi").alias("m"))
    large = both.where("lo > hi").join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
    low = large.groupBy("hi").agg(F.min("lo").alias("m"))
    met = large.join(low, "hi")
    small = met.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return small.union(low.select("hi", F.col("m").alias("lo"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` for every node that has an edge in ``edges`` (its first two columns, longs).

    Nodes without an edge, nulls and loops are left out: their component is their own id.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    current = stage(pairs.mapInArrow(_contract, "hi long, lo long").distinct(), name)
    seen = None
    while True:
        # Where every node has one neighbour, and no neighbour has one of its own, all are stars.
        state = current.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        current = stage(_round(current), name)
    # The smallest members point to themselves.
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
