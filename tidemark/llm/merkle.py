"""Merkle manifest of a dataset: a root, and for every row the siblings that prove it.

Every row is hashed to a leaf where it is read, so only ids, tree names and digests are
shuffled. Leaves are put in order by a range exchange and numbered by counts of the ranges
before them. ``2 ** height`` neighbouring leaves, aligned to that number, are a block. A
task appends a block's leaves one at a time: complete subtrees stay open with partial
witnesses (the siblings met so far) of the leaves below them, and a sibling that completes
extends both sides' witnesses. Block roots are appended in turn as the leaves of blocks of
roots, and so on until every tree has one node; the trees' roots are a last tree.

Roots climb first and witnesses descend after: a block's own witness from the levels above
is joined to the block, and its leaves meet it in the task that makes theirs, so no
witness of a leaf is ever shuffled. A block has a bounded number of leaves whatever tree or
id holds how many rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import ship_package, shuffle_width, stage

HEIGHT = 12
ALONE, LEFT, RIGHT = 0, 1, 2


def join_hash(*digests: bytes) -> bytes:
    """The hash of digests written as lowercase hexadecimal text, end to end."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


class Append:
    """A tree that grows by one node at a time.

    ``open`` holds complete subtrees as [height, root, first node]; the witness of a node
    lists (side, sibling digest) from the bottom up. ``ALONE`` marks a node without sibling.
    """

    def __init__(self) -> None:
        self.open: list[list] = []
        self.witness: list[list[tuple[int, bytes]]] = []

    def add(self, digest: bytes) -> None:
        self.open.append([0, digest, len(self.witness)])
        self.witness.append([])
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._complete()

    def _complete(self) -> None:
        height, right, middle = self.open.pop()
        _, left, first = self.open[-1]
        for w in self.witness[first:middle]:
            w.append((RIGHT, right))
        for w in self.witness[middle:]:
            w.append((LEFT, left))
        self.open[-1] = [height + 1, join_hash(left, right), first]

    def close(self, height: int | None) -> bytes:
        """The root: of ``height`` if it is given, else as low as one node allows. Nodes without sibling rise alone."""
        while len(self.open) > 1 or (height is not None and self.open[-1][0] < height):
            if len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
                self._complete()
                continue
            low, root, first = self.open[-1]
            for w in self.witness[first:]:
                w.append((ALONE, b""))
            self.open[-1] = [low + 1, join_hash(root), first]
        return self.open[-1][1]


def pack(witness: list[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes([side]) + sibling for side, sibling in witness)


def unpack(packed: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(packed):
        size = 32 if packed[at] else 0
        out.append((packed[at], packed[at + 1 : at + 1 + size]))
        at += 1 + size
    return out


def fold(digest: bytes, witness: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf and its witness give."""
    for side, sibling in witness:
        digest = join_hash(sibling, digest) if side == LEFT else join_hash(digest, sibling) if side == RIGHT else join_hash(digest)
    return digest


def field(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _append(table: pa.Table, height: int):
    """Nodes of one block in order, the tree that grew of them, and its root."""
    table = table.sort_by("pos")
    grown = Append()
    for digest in table.column("digest").to_pylist():
        grown.add(digest)
    return table, grown, grown.close(height if table.column("blocks")[0].as_py() > 1 else None)


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """``nodes (tree, pos, n, digest)`` with their block, and the number of blocks of their tree."""
    return nodes.withColumn("block", F.shiftright("pos", height)).withColumn("blocks", F.shiftright(F.col("n") - 1, height) + 1)


def _roots(nodes: DataFrame, height: int) -> DataFrame:
    """One node for each block, in the tree of blocks."""

    def run(table: pa.Table) -> pa.Table:
        table, _, root = _append(table, height)
        return pa.table({"tree": table.column("tree")[:1], "pos": table.column("block")[:1].cast(pa.int64()),
                         "n": table.column("blocks")[:1].cast(pa.int64()), "digest": pa.array([root], pa.binary())})

    return nodes.select("tree", "pos", "n", "digest", "block", "blocks").groupBy("tree", "block").applyInArrow(
        run, "tree long, pos long, n long, digest binary")


def _descend(nodes: DataFrame, above: DataFrame | None, height: int) -> DataFrame:
    """``(tree, pos, witness)``: of every node up to its tree's root; ``above (tree, pos, witness)`` has that of the blocks."""

    def run(table: pa.Table) -> pa.Table:
        upper = table.column("upper")[0].as_py() or b""
        table, grown, _ = _append(table, height)
        return pa.table({"tree": table.column("tree"), "pos": table.column("pos"),
                         "witness": pa.array([pack(w) + upper for w in grown.witness], pa.binary())})

    if above is None:
        nodes = nodes.withColumn("upper", F.expr("X''"))
    else:
        nodes = nodes.join(above.select("tree", F.col("pos").alias("block"), F.col("witness").alias("upper")), ["tree", "block"], "left")
    return nodes.groupBy("tree", "block").applyInArrow(run, "tree long, pos long, witness binary")


def _climb(nodes: DataFrame, height: int, name: str):
    """Levels of ``nodes (tree, pos, n, digest)`` from the bottom up; the last has a node a tree."""
    levels = [nodes]
    while levels[-1].where("n > 1").limit(1).count():
        levels.append(stage(_blocks(_roots(levels[-1], height), height), name))
    return levels


def _witnesses(levels: list[DataFrame], height: int, name: str) -> DataFrame | None:
    """Witnesses of the nodes of the second level, which are the blocks of the first."""
    above = None
    for level in reversed(levels[1:]):
        above = stage(_descend(level, above, height), name)
    return above


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``tree`` (a number of each value of ``key``, in their order), ``pos`` in it and its size ``n``.

    Ranges follow the whole order, so one key or id may hold any share of the rows; rows
    equal in all of it are told apart by where they were read.
    """
    # Written first: finding the ranges reads the rows once more.
    spread = stage(rows, f"{name}-read").withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    cut = ["key", *order, "_tie"]
    spread = spread.repartitionByRange(4 * shuffle_width(rows.sparkSession), *[F.col(c).asc_nulls_first() for c in cut])
    spread = spread.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in cut]).withColumn("_at", F.monotonically_increasing_id())
    placed = stage(spread.drop("_tie").withColumn("_range", F.shiftright("_at", 33)), name)
    parts = placed.groupBy("key", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_here"))
    # A row for each key of each range: no more than keys and ranges together.
    parts = stage(parts, f"{name}-parts")
    keys = parts.groupBy("key").agg(F.sum("_here").alias("n"))
    own = Window.partitionBy("key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_here").over(own), F.lit(0)))
    parts = parts.join(_tree_numbers(keys, name), parts["key"].eqNullSafe(F.col("k")), "inner").drop("k")
    there = parts.select(F.col("key").alias("_k"), F.col("_range").alias("_r"), "_first", "_before", "tree", "n")
    return placed.join(there, placed["key"].eqNullSafe(there["_k"]) & (placed["_range"] == there["_r"])).withColumn(
        "pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_k", "_r", "_first", "_before", "_at", "_range")


def _tree_numbers(keys: DataFrame, name: str) -> DataFrame:
    """``(k, n, tree)``: keys numbered in order, null first, by ranges as rows are."""
    ranged = keys.repartitionByRange(F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first())
    ranged = stage(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)), f"{name}-keys")
    parts = ranged.groupBy("_range").agg(F.count("*").alias("_here"), F.min("_at").alias("_first"))  # a row a range
    before = F.coalesce(F.sum("_here").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_before", before)
    return ranged.join(parts, "_range").select(
        F.col("key").alias("k"), "n", (F.col("_at") - F.col("_first") + F.col("_before")).alias("tree"))


def manifest(rows: DataFrame, columns: list[str], key: str, id_col: str, changed: dict[str, Column] | None = None,
             is_changed: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """``(id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of every row, digests as lowercase hexadecimal.

    A row's leaf is the hash of its ``columns`` (see ``field``). The rows of each value of
    ``key`` are a tree in ascending order of ``id_col``; the trees' roots, in ascending order
    of ``key``, null first, are the leaves of the root's tree. Two neighbours become one node, a last
    node without neighbour the hash of itself, until one is left; a lone leaf is its own root.
    ``proof_sha256`` is the hash of a row's siblings from the bottom up. ``folded_root`` is
    what they make of the row as it is now: where ``is_changed`` holds, of its values with
    those in ``changed`` put in. ``verified`` says whether that is the root.

    Null ids come first in their tree. Rows of one id are ordered by their leaves, and equal
    rows are leaves each, in any order. Null texts differ from empty ones. An empty table
    gives no rows; columns not named take no part.
    """
    spark = rows.sparkSession
    ship_package(spark)

    def leaf(values: list[Column]) -> Column:
        return F.unhex(F.sha2(F.concat(*map(field, values)), 256))

    now = F.lit(None).cast("binary")
    if changed:
        now = F.when(is_changed, leaf([changed.get(c, F.col(c)) for c in columns]))
    leaves = rows.select(
        F.col(key).alias("key"), F.col(id_col).alias("id"), leaf([F.col(c) for c in columns]).alias("digest"), now.alias("now"))
    placed = stage(_blocks(_numbered(leaves, ["id", "digest"], "manifest-leaves"), height), "manifest-placed")

    levels = _climb(placed.select("tree", "pos", "n", "digest", "block", "blocks"), height, "manifest-level")
    above = _witnesses(levels, height, "manifest-witness")
    if above is None:  # no tree of two leaves
        above = spark.createDataFrame([], "tree long, pos long, witness binary")
    subroots = stage(levels[-1].select("tree", "digest"), "manifest-subroots")  # a tree of one leaf is its own root
    many = F.lit(subroots.count()).cast("long")
    trees = stage(_blocks(subroots.select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), many.alias("n"), "digest"), height), "manifest-trees")
    upper = _climb(trees, height, "manifest-top")
    top = upper[-1].first()
    root = F.lit(top["digest"].hex() if top else None).cast("string")
    over = _descend(trees, _witnesses(upper, height, "manifest-top-witness"), height)
    over = over.select(F.col("pos").alias("tree"), F.col("witness").alias("over"))
    tops = stage(subroots.join(over, "tree").select("tree", F.col("digest").alias("subroot"), "over"), "manifest-tops")

    def run(table: pa.Table) -> pa.Table:
        upper = (table.column("upper")[0].as_py() or b"") + table.column("over")[0].as_py()
        table, grown, _ = _append(table, height)
        upper, proof, folded = unpack(upper), [], []
        for w, digest, now in zip(grown.witness, table.column("digest").to_pylist(), table.column("now").to_pylist()):
            whole = w + upper
            proof.append(join_hash(*[s for side, s in whole if side]))
            folded.append(fold(digest if now is None else now, whole))
        return pa.table({"id": table.column("id"), "digest": table.column("digest"), "subroot": table.column("subroot"),
                         "proof": pa.array(proof, pa.binary()), "folded": pa.array(folded, pa.binary())})

    met = placed.join(above.select("tree", F.col("pos").alias("block"), F.col("witness").alias("upper")), ["tree", "block"], "left").join(tops, "tree")
    met = met.select("tree", "block", "blocks", "pos", "id", "digest", "now", "upper", "subroot", "over")
    proved = met.groupBy("tree", "block").applyInArrow(
        run, f"id {placed.schema['id'].dataType.simpleString()}, digest binary, subroot binary, proof binary, folded binary")

    def text(c: str) -> Column:
        return F.lower(F.hex(c))

    return proved.select(
        "id", text("digest").alias("leaf"), text("subroot").alias("subroot"), root.alias("root"),
        text("proof").alias("proof_sha256"), text("folded").alias("folded_root"), (text("folded") == root).alias("verified"))
