"""Near-duplicate vectors: random-hyperplane signatures in several tables, exact cosine, components.

Equal vectors fall into one class first, so a vector that a third of all rows repeat is
compared once. A class is in one bucket of every table, named by the signs of its products
with that table's hyperplanes. A bucket's members are compared with each other by one
matrix product in double precision; buckets over ``chunk`` members are dealt as pairs of
chunks. A pair found in several tables counts in the first one they share. Buckets send
sums of links and a spanning forest, never pairs.

Signatures grow by a bit with every doubling of the classes, so buckets keep their size,
and tables are added until a pair at the threshold itself meets with probability ``recall``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import Forest, components
from tidemark.llm.vectors import matrix, usable
from tidemark.session import ship_package, shuffle_width, stage

PER_BUCKET, CHUNK, MOST_BITS = 32, 2048, 30


def plan_tables(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """Bits of a signature and number of tables for n vectors."""
    bits = min(MOST_BITS, max(1, round(math.log2(max(2, n / PER_BUCKET)))))
    meet = (1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet))) if meet < 1 else 1


def signatures(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """A whole number of ``bits`` bits for every vector and table.

    Vectors and hyperplanes are rounded to whole numbers whose products floats hold exactly,
    so a vector has the same signature in every matrix that it is a row of.
    """
    planes = np.rint(np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], bits * tables)) * 2**10)
    whole = np.rint(vectors / np.maximum(np.abs(vectors).max(1, keepdims=True), np.finfo(float).tiny) * 2**20)
    signs = (whole @ planes > 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _compare(units, sigs, table, copies, cosine, side):
    """Links of each member (copies counted), and joining pairs."""
    n = len(units)
    links, forest, found = np.zeros(n, np.int64), Forest(), []
    for i in range(n - 1):
        j = np.flatnonzero(units[i + 1 :] @ units[i] >= cosine) + i + 1
        if side is not None:
            j = j[side[j] != side[i]]
        j = j[~(sigs[j, :table] == sigs[i, :table]).any(1)]
        links[i] += copies[j].sum()
        links[j] += copies[i]
        found += [(i, int(x)) for x in j if forest.join(i, int(x))]
    return links, found


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.999, seed: int = 17, chunk: int = CHUNK,
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row.

    Null and zero vectors and those with null or non-finite components link with nothing, nor
    do vectors of different lengths. Rows of equal vectors link with each other, whatever
    their ids: rows of one id with different vectors have links and components each, and rows
    with null ids link others and get the smallest id reachable, null where all are null (so is
    ``kept``). Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    # Floats travel as floats; all arithmetic is in doubles.
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))
    fit = usable(F.col("v")) & F.exists("v", lambda x: x != 0)
    # Adding zero makes -0.0 and 0.0 the same.
    text = F.to_json(F.struct(F.transform("v", lambda x: x.cast("double") + F.lit(0.0)).alias("v")))
    keyed = stage(rows.select("vec_id", F.when(fit, F.sha2(text, 256)).alias("key"), F.when(fit, F.col("v")).alias("v")), "vectors")
    classes = keyed.where("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    # Classes have numbers of their own: ids may be null, or stand for different vectors.
    classes = stage(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    bits, tables = plan_tables(classes.count(), cosine, recall)

    def sign(batches):
        for batch in batches:
            v, width = batch.column(2), batch.column(2).value_lengths()
            sigs = np.zeros((len(v), tables), np.int64)
            for w in set(width.to_pylist()):
                own = np.flatnonzero(np.array(width.to_pylist()) == w)
                sigs[own] = signatures(matrix(v.take(pa.array(own)), np.float64), bits, tables, seed)
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * tables, pa.int32()), pa.array(sigs.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), v, out], ["cid", "copies", "v", "sigs"])

    signed = stage(classes.select("cid", "copies", "v").mapInArrow(sign, f"cid long, copies long, v {kind}, sigs array<long>"),
                   "vector-signatures", spread_by="cid")
    placed = signed.select("cid", "copies", "v", F.size("v").alias("dim"), F.posexplode("sigs").alias("t", "sig"))
    sizes = placed.groupBy("t", "dim", "sig").agg(F.count("*").alias("n")).where("n > 1")
    dealt = (
        placed.join(sizes, ["t", "dim", "sig"])
        .withColumn("chunks", F.ceil(F.col("n") / chunk).cast("long"))
        .withColumn("part", F.pmod(F.xxhash64("cid"), F.col("chunks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .withColumn("task", F.least("part", "other") * F.col("chunks") + F.greatest("part", "other"))
        .select("cid", "copies", "v", "t", "dim", "sig", "part", "task", (F.col("part") != F.col("other")).alias("crossed"))
        .withColumn("bin", F.pmod(F.xxhash64("t", "dim", "sig", "task"), F.lit(16 * shuffle_width(spark))))
    )

    def search(table: pa.Table) -> pa.Table:
        get = {c: np.array(table.column(c).to_pylist()) for c in ("cid", "copies", "t", "dim", "sig", "part", "task", "crossed")}
        order = np.lexsort((get["task"], get["sig"], get["dim"], get["t"]))
        change = sum(np.diff(get[c][order]) != 0 for c in ("task", "sig", "dim", "t"))
        vs, out = table.column("v").combine_chunks(), []
        for own in np.split(order, np.flatnonzero(change) + 1):
            if len(own) < 2:
                continue
            v = matrix(vs.take(pa.array(own)), np.float64)
            sigs = signatures(v, bits, tables, seed)
            v = v / np.abs(v).max(1, keepdims=True)
            v /= np.sqrt((v * v).sum(1, keepdims=True))
            side = get["part"][own] if get["crossed"][own[0]] else None
            links, found = _compare(v, sigs, int(get["t"][own[0]]), get["copies"][own], cosine, side)
            rep = get["cid"][own]
            out += [(int(rep[i]), None, int(links[i])) for i in np.flatnonzero(links)]
            out += [(int(rep[i]), int(rep[j]), 0) for i, j in found]
        return pa.table({c: pa.array([o[i] for o in out], pa.int64()) for i, c in enumerate(("a", "b", "links"))})

    found = stage(dealt.groupBy("bin").applyInArrow(search, "a long, b long, links long"), "vector-links")
    links = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    joined = components(found.where("b is not null").select("a", "b"), "vector-components").withColumnRenamed("node", "cid")
    named = classes.select("key", "cid", "rep", "copies").join(links, "cid", "left").join(joined, "cid", "left").select(
        "key", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    named = stage(named, "vector-named")
    per_class = named.join(named.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("key", "n_links", "component_id")
    out = keyed.select("vec_id", "key").join(per_class, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
