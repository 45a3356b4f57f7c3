"""Hard negatives of anchors: slot-decomposed selection over blocks of exact inner products.

An anchor's positives are its best rows of the same label. Each positive has a window of
scores, and a negative belongs to it if its score lies inside. Windows of one anchor
overlap, so a row would be a candidate of several of them. Instead the windows' upper
limits cut the scores into disjoint slots, highest first: a row falls into one slot, every
block of rows keeps the k best rows of each slot, and the blocks' lists are cut to k again
before they are shuffled and after. Slots descend, so an anchor's slots laid end to end are
in order of score, and a window's answer is the first k rows of the suffix that begins at
its slot; what lies below its lower limit is then taken off.

Two passes, as limits must be known before slots: rows meet the anchors of their own label,
then all anchors. In both, rows and anchors are dealt by hash into blocks of bounded size,
every block of rows meets every block of anchors once, and a label that a third of all rows
bear is many blocks. Whole-number components travel in as few bytes as hold them all.
Scores are matrix products in the narrowest floats that hold them exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.vectors import matrix, products, usable
from tidemark.session import ship_package, shuffle_width, stage

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
#: Most rows and anchors of a block; fewer where the tables would give less than a block a core.
ROWS, ANCHORS, LEAST = 32_768, 32_768, 2048
#: Scores held at a time in a task.
STRIP = 1 << 21


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores in order, ties by smaller id."""
    at = np.arange(len(score))
    if len(at) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def slot_lists(score: np.ndarray, ids: np.ndarray, limits: np.ndarray, floor: int, k: int) -> list[tuple[int, np.ndarray]]:
    """(slot, places of its k best rows) of one anchor; slot i holds scores above the next of ``limits``, which descend, up to the ith."""
    out, bottom = [], [*limits[1:], floor - 1]
    for slot, (top, below) in enumerate(zip(limits, bottom)):
        at = np.flatnonzero((score <= top) & (score > below))
        if len(at):
            out.append((slot, at[best(score[at], ids[at], k)]))
    return out


def _strips(anchors: np.ndarray, rows: np.ndarray):
    step = max(1, STRIP // max(1, len(rows)))
    for lo in range(0, len(anchors), step):
        yield from zip(range(lo, len(anchors)), products(anchors[lo : lo + step], rows))


def _halves(table: pa.Table):
    asks = np.array(table.column("asks").to_pylist(), bool)
    v = matrix(table.column("v"), np.float64)
    ids = np.array(table.column("id").to_pylist(), np.int64)
    return asks, ids, v


def _positives(k: int):
    def run(table: pa.Table) -> pa.Table:
        asks, ids, v = _halves(table)
        no = np.array(table.column("no").to_pylist(), object)
        out, rows, who, names = [], ids[~asks], ids[asks], no[asks]
        for i, score in _strips(v[asks], v[~asks]) if asks.any() and not asks.all() else ():
            other = np.flatnonzero(rows != who[i])
            out += [(names[i], int(rows[j]), int(score[j])) for j in other[best(score[other], rows[other], k)]]
        return pa.table({c: pa.array([o[i] for o in out], pa.int64()) for i, c in enumerate(("no", "id", "score"))})

    return run


def _negatives(k: int):
    def run(table: pa.Table) -> pa.Table:
        asks, ids, v = _halves(table)
        get = {c: np.array(table.column(c).to_pylist(), object) for c in ("no", "limits", "floor", "label")}
        out, rows, labels = [], ids[~asks], get["label"][~asks]
        who = np.flatnonzero(asks)
        for i, score in _strips(v[asks], v[~asks]) if asks.any() and not asks.all() else ():
            a = who[i]
            other = np.flatnonzero((labels != get["label"][a]) & (score <= get["limits"][a][0]) & (score >= get["floor"][a]))
            for slot, at in slot_lists(score[other], rows[other], get["limits"][a], get["floor"][a], k):
                out += [(get["no"][a], slot, int(rows[other[j]]), int(score[other[j]])) for j in at]
        return pa.table({c: pa.array([o[i] for o in out], pa.int64()) for i, c in enumerate(("no", "slot", "id", "score"))})

    return run


def _block(n: Column) -> Column:
    return F.pmod(F.xxhash64("id"), n).cast("int")


def _each(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n.cast("int") - 1))


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each key; Spark cuts every task's rows to k a key before it shuffles them."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _narrowest(rows: DataFrame) -> str:
    """The smallest type that holds every component."""
    most = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0] or 0.0
    return next((t for t, top in (("tinyint", 127), ("smallint", 32767), ("int", 2**31 - 1)) if most <= top), "double")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         rows_per_block: int = ROWS, anchors_per_block: int = ANCHORS) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    A component x counts as floor(scale * x); scores are inner products. Of each row that
    ``is_anchor`` names, the first ``positives`` other rows of its label are its positives,
    best first, ties by smaller id; of each positive, the first ``negatives`` rows of other
    labels whose score lies between ``low`` and ``high`` per cent of the positive's are
    returned, ranked from 1 among those. So a negative positive score has no negatives.

    Rows with a null id, label or vector, or with null or non-finite components, take no part.
    Missing components count as zero. Rows of the anchor's own id are not other rows. Repeated
    rows are candidates each and one anchor; rows of one id that differ are anchors each.
    An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    fit = usable(F.col(vector_col)) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()
    rows = vectors.where(fit).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), whole.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    small = _narrowest(rows)
    rows = stage(rows.withColumn("v", F.col("v").cast(f"array<{small}>")), "negatives-rows")
    anchors = rows.where("asks").select("id", "label", "v").distinct().withColumn("no", F.monotonically_increasing_id())
    anchors = stage(anchors, "negatives-anchors")
    cores = shuffle_width(spark)

    def size(n: Column, most: int) -> Column:
        """Blocks of n rows."""
        return F.greatest(F.ceil(n / most), F.least(F.lit(cores), F.ceil(n / LEAST))).cast("int")

    # Labels whose anchors and rows meet, with the number of their blocks: a row a label.
    per = rows.groupBy("label").agg(size(F.count("*"), rows_per_block).alias("n_rows"))
    per = per.join(anchors.groupBy("label").agg(F.ceil(F.count("*") / anchors_per_block).cast("int").alias("n_anchors")), "label")
    per = stage(per, "negatives-labels")
    columns = ["label", "r", "q", "asks", "id", "no", "v"]
    own = rows.join(per, "label").select(
        "label", _block(F.col("n_rows")).alias("r"), _each(F.col("n_anchors")).alias("q"), F.lit(False).alias("asks"), "id", F.lit(None).cast("long").alias("no"), "v")
    asked = anchors.join(per, "label").select(
        "label", _each(F.col("n_rows")).alias("r"), _block(F.col("n_anchors")).alias("q"), F.lit(True).alias("asks"), "id", "no", "v")
    met = own.select(columns).union(asked.select(columns)).groupBy("label", "r", "q")
    found = _top(met.applyInArrow(_positives(positives), "no long, id long, score long"), ["no"], positives)
    chosen = stage(found.select("no", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")

    # Wide decimals: a limit is a score times a percentage.
    percent = F.col("positive_score").cast("decimal(38,0)")
    windows = chosen.select(
        "*", F.floor(percent * high / 100).cast("long").alias("top"), F.ceil(percent * low / 100).cast("long").alias("bottom")).where("bottom <= top")
    limits = windows.groupBy("no").agg(
        F.sort_array(F.collect_set("top"), asc=False).alias("limits"), F.min("bottom").alias("floor"))  # at most ``positives`` of them
    asking = stage(anchors.join(limits, "no"), "negatives-limits")
    n_rows = size(F.lit(rows.count()), rows_per_block)
    n_anchors = F.greatest(F.lit(1), F.ceil(F.lit(asking.count()) / anchors_per_block)).cast("int")
    columns = ["r", "q", "asks", "id", "label", "no", "v", "limits", "floor"]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("no", "long"), ("limits", "array<long>"), ("floor", "long"))]
    own = rows.select("id", "label", "v", *none, _block(F.greatest(n_rows, F.lit(1))).alias("r"), _each(n_anchors).alias("q"), F.lit(False).alias("asks"))
    asked = asking.select(
        "id", "label", "v", "no", "limits", "floor", _each(F.greatest(n_rows, F.lit(1))).alias("r"), _block(n_anchors).alias("q"), F.lit(True).alias("asks"))
    met = own.select(columns).union(asked.select(columns)).groupBy("r", "q")
    found = _top(met.applyInArrow(_negatives(negatives), "no long, slot long, id long, score long"), ["no", "slot"], negatives)

    # An anchor's slots end to end are at most positives * negatives rows, best first.
    lists = found.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("slot", (-F.col("score")).alias("minus"), "id"))).alias("found"))
    slot = F.array_position("limits", F.col("top")) - 1
    suffix = F.slice(F.filter("found", lambda x: x["slot"] >= F.col("slot")), 1, negatives)
    answers = (
        windows.join(asking.select("no", F.col("id").alias("anchor_id"), "limits"), "no").withColumn("slot", slot).join(lists, "no")
        .select("anchor_id", "positive_id", "positive_score", F.posexplode(F.filter(suffix, lambda x: -x["minus"] >= F.col("bottom"))).alias("at", "row"))
    )
    return answers.select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("row.id").alias("negative_id"),
        "positive_score", (-F.col("row.minus")).alias("negative_score"))
