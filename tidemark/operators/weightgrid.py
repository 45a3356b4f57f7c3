"""Weight-space search: gap, closure and rank agreement of many weight vectors.

Two thousand vectors times every seed would be a very large shuffle. The gap of a
vector only needs its median score and two class sums, so rows are scored inside
the task and only per-vector sums leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.scoring import Regime, score_long, weighted
from tidemark.operators.contrasts import bootstrap_contrasts
from tidemark.operators.ranks import average_rank, fits_one_task, ordered_counts
from tidemark.operators.reach import class_means, exposure, with_reach
from tidemark.session import shuffle_width, stage

_P = [f"p_{h}" for h in K.HEADS]
_SLICES = 256
_FETCH = 512
_BLOCK = 128
_SAMPLE = 8192
_SENT_ROWS, _PIECE = 12_000_000, 1_000_000  # of six numbers: what a task holds, and what the driver holds at a time


def weight_grid() -> list[dict[str, float]]:
    """Weight vectors over (fast share, reply part of slow, retweet part of fast)."""
    fast = [
        *np.linspace(0.0, 0.10, 21).tolist(),
        *np.linspace(0.11, 0.30, 20).tolist(),
        *np.linspace(0.32, 1.00, 35).tolist(),
    ]
    w = K.WEIGHTS
    slow_split = sorted({0.0, 0.25, 0.5, 0.75, w["reply"] / (w["reply"] + w["deep"]), 0.9, 1.0})
    fast_split = sorted({0.0, 0.5, w["retweet"] / (w["retweet"] + w["like"]), 1.0})
    return [
        {"reply": (1.0 - f) * s, "retweet": f * t, "like": f * (1.0 - t), "deep": (1.0 - f) * (1.0 - s)}
        for f in fast
        for s in slow_split
        for t in fast_split
    ]


def named_weights() -> dict[str, dict[str, float]]:
    w = K.WEIGHTS
    return {
        "published": dict(w),
        "halved_reply": dict(w, reply=w["reply"] / 2.0),
        "slow_only": dict(w, retweet=0.0, like=0.0),
        "fast_only": dict(w, reply=0.0, deep=0.0),
        "uniform": dict.fromkeys(K.HEADS, 1.0),
    }


#: Another published weight vector. Fixed values.
PUBLISHED_2026 = {"reply": 5.0, "retweet": 1.0, "like": 0.5, "deep": 5.0}


def describe_weights(weights: dict[str, float]) -> dict[str, float | None]:
    """Normalised weights and the shares they came from; null where undefined."""
    total = sum(weights[h] for h in K.HEADS)
    n = {h: weights[h] / total for h in K.HEADS}
    slow, fast = n["reply"] + n["deep"], n["retweet"] + n["like"]
    return {
        **{f"w_{h}": n[h] for h in K.HEADS},
        "fast_share": fast,
        "reply_of_slow": n["reply"] / slow if slow > 0 else None,
        "retweet_of_fast": n["retweet"] / fast if fast > 0 else None,
    }


def vector_table(spark, vectors: Sequence[dict[str, float]]) -> DataFrame:
    """The vectors as rows (v, shares...); the parameter list, not data."""
    rows = [(i, *describe_weights(w).values()) for i, w in enumerate(vectors)]
    names = ["w_reply", "w_retweet", "w_like", "w_deep", "fast_share", "reply_of_slow", "retweet_of_fast"]
    return spark.createDataFrame(rows, "v int, " + ", ".join(f"{n} double" for n in names))


def distinct_rows(seeds: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(p_<head>..., keep..., __n): seeds that agree in all of these once, with their number; written, dealt evenly."""
    rows = seeds.groupBy(*_P, *keep).agg(F.count(F.lit(1)).alias("__n"))
    return stage(rows.withColumn("__deal", F.xxhash64(*_P, *keep)), "distinct-seeds", "__deal").drop("__deal")


def _score_blocks(frames: Iterator[pd.DataFrame], w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, pd.DataFrame, slice]]:
    """Scores of up to ``_BLOCK`` rows under every vector, summed head by head, the rows' numbers and their place in a frame.

    Blocks are small enough to stay in a core's cache.
    """
    for frame in frames:
        p, n = frame[_P].to_numpy(np.float64), frame["__n"].to_numpy(np.float64)
        for start in range(0, len(frame), _BLOCK):
            at = slice(start, start + _BLOCK)
            s = p[at, 0][:, None] * w[0]
            for h in range(1, len(_P)):
                s += p[at, h][:, None] * w[h]
            yield s, n[at], frame, at


def vector_medians(rows: DataFrame, w: np.ndarray) -> np.ndarray:
    """Exact median score of every vector over seeds or their ``distinct_rows``; ``w`` is heads by vectors.

    A hash sample guesses an interval around the two middle order statistics. Passes
    narrow it: each counts the rows below it and per slice and keeps the slices that hold
    them; a guess that missed is replaced by all scores of its vector. Slice bounds are real
    scores, so the interval shrinks even when many rows share one value. Once few
    rows remain inside, they are fetched and the middle ones read off.
    """
    p = (rows if "__n" in rows.columns else distinct_rows(rows)).select(*_P, "__n")
    size = p.agg(F.count(F.lit(1)).alias("rows"), F.sum("__n").alias("n")).first()
    if not size["rows"]:
        return np.full(w.shape[1], np.nan)
    first, second = (size["n"] - 1) // 2, size["n"] // 2
    lo, hi = _guess(p, w, size["rows"])
    below = np.zeros(w.shape[1], dtype=np.int64)
    inside, todo = np.full(w.shape[1], size["rows"]), np.arange(w.shape[1])
    while len(todo):
        lo[todo], hi[todo], below[todo], inside[todo] = _narrow(p, w[:, todo], lo[todo], hi[todo], first, second)
        missed = todo[inside[todo] == 0]
        if len(missed):
            lo[missed], hi[missed] = _extent(p, w[:, missed])
        todo = np.flatnonzero((inside == 0) | (inside > _FETCH) & (lo < hi))
    out = lo.copy()
    todo = np.flatnonzero(lo < hi)
    if len(todo):
        sub, sub_lo, sub_hi = w[:, todo], lo[todo], hi[todo]

        def fetch(frames):
            for s, n, _, _ in _score_blocks(frames, sub):
                r, c = np.nonzero((s >= sub_lo) & (s <= sub_hi))
                yield pd.DataFrame({"v": c, "s": s[r, c], "n": n[r].astype(np.int64)})

        found = p.mapInPandas(fetch, "v int, s double, n long").groupBy("v", "s").agg(F.sum("n").alias("n")).toPandas()
        for v, own in found.sort_values("s").groupby("v"):
            at, upto = todo[v], below[todo[v]] + own["n"].cumsum().to_numpy()
            s = own["s"].to_numpy()
            out[at] = 0.5 * (s[np.searchsorted(upto, first, "right")] + s[np.searchsorted(upto, second, "right")])
    return out


def _guess(p: DataFrame, w: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """An interval per vector that should hold its median, from about ``_SAMPLE`` rows; the passes that follow check it."""
    every = max(1, n_rows // _SAMPLE)
    frame = p.where(F.pmod(F.xxhash64(*_P), F.lit(every)) == 0).toPandas()
    if every > 1 and len(frame) < _SAMPLE // 8:
        return _extent(p, w)
    lo, hi = np.empty(w.shape[1]), np.empty(w.shape[1])
    heads, n = frame[_P].to_numpy(np.float64), frame["__n"].to_numpy(np.float64)
    slack = 3.0 / np.sqrt(len(frame)) if every > 1 else 0.0
    for start in range(0, w.shape[1], 64):
        part = w[:, start : start + 64]
        s = heads[:, [0]] * part[0]
        for h in range(1, len(_P)):
            s += heads[:, [h]] * part[h]
        order = np.argsort(s, axis=0)
        s, share = np.take_along_axis(s, order, 0), np.cumsum(n[order], axis=0) / n.sum()
        at = np.arange(s.shape[1])
        lo[start : start + 64] = s[np.argmax(share >= 0.5 - slack - 1e-9, axis=0), at]
        top = np.minimum((share <= 0.5 + slack + 1e-9).sum(0), len(s) - 1)
        hi[start : start + 64] = s[top, at]
    return lo, hi


def _extent(p: DataFrame, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of every vector."""
    n_vec = w.shape[1]

    def run(frames):
        lo, hi = np.full(n_vec, np.inf), np.full(n_vec, -np.inf)
        for s, _, _, _ in _score_blocks(frames, w):
            lo, hi = np.minimum(lo, s.min(0)), np.maximum(hi, s.max(0))
        yield pd.DataFrame({"v": np.arange(n_vec), "lo": lo, "hi": hi})

    state = (
        p.mapInPandas(run, "v int, lo double, hi double")
        .groupBy("v").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("v").toPandas()
    )
    return state["lo"].to_numpy(), state["hi"].to_numpy()


def _narrow(p: DataFrame, w: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: int, second: int):
    """One counting pass: the slices of [lo, hi] that hold positions first..second, the rows below them and
    the distinct rows in them; no rows where a position lies outside [lo, hi]."""
    n_vec = w.shape[1]
    width = np.where(hi > lo, (hi - lo) / _SLICES, 1.0)

    def run(frames):
        size = n_vec * _SLICES
        count, rows = np.zeros(size), np.zeros(size, np.int64)
        low, high = np.full(size, np.inf), np.full(size, -np.inf)
        under = np.zeros(n_vec)
        for s, n, _, _ in _score_blocks(frames, w):
            short = s < lo
            under += n @ short.astype(np.float64)
            r, c = np.nonzero(~short & (s <= hi))
            x = s[r, c]
            at = np.minimum(((x - lo[c]) / width[c]).astype(np.int64), _SLICES - 1) + c * _SLICES
            np.add.at(count, at, n[r])
            np.add.at(rows, at, 1)
            np.minimum.at(low, at, x)
            np.maximum.at(high, at, x)
        at = np.flatnonzero(rows)
        yield pd.DataFrame({"v": np.arange(n_vec), "slot": -1, "c": under.astype(np.int64), "m": 0, "lo": 0.0, "hi": 0.0})
        yield pd.DataFrame(
            {"v": at // _SLICES, "slot": at % _SLICES, "c": count[at].astype(np.int64), "m": rows[at], "lo": low[at], "hi": high[at]}
        )

    running = Window.partitionBy("v").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    slots = (
        p.mapInPandas(run, "v int, slot int, c long, m long, lo double, hi double")
        .groupBy("v", "slot")
        .agg(F.sum("c").alias("c"), F.sum("m").alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .withColumn("upto", F.sum("c").over(running))
    )
    before = F.col("upto") - F.col("c")
    kept = (
        slots.where((F.col("slot") >= 0) & (F.col("upto") > first) & (before <= second))
        .groupBy("v")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("m").alias("m"), F.min(before).alias("below"), F.max("upto").alias("upto"))
        .where((F.col("below") <= first) & (F.col("upto") > second))
        .toPandas().set_index("v").reindex(np.arange(n_vec))
    )
    inside = kept["m"].fillna(0).to_numpy(np.int64)
    return (
        np.where(inside > 0, kept["lo"], lo), np.where(inside > 0, kept["hi"], hi),
        kept["below"].fillna(0).to_numpy(np.int64), inside,
    )


def vector_gaps(seeds: DataFrame, vectors: Sequence[dict[str, float]], baseline: float) -> DataFrame:
    """Low minus high mean reach per vector: rows (v, median, low_mean, high_mean, gap).

    Seeds alike in propensities and label are scored once and counted as often as they occur.
    """
    w = np.array([[v[h] for v in vectors] for h in K.HEADS])
    rows = distinct_rows(seeds, ["label"])
    medians = vector_medians(rows, w)
    usable = np.isfinite(medians) & (medians > 0)
    safe = np.where(usable, medians, 1.0)

    def run(frames):
        sums = np.zeros((2, w.shape[1]))
        counts = np.zeros(2)
        for s, n, frame, at in _score_blocks(frames, w):
            s /= safe
            rel = np.where(usable, s, 1.0)
            rel *= baseline
            reach = np.clip(rel, K.EXPOSURE_MIN, K.EXPOSURE_MAX, out=rel)
            label = frame["label"].to_numpy()[at]
            own = np.stack([n * (label == K.LOW), n * (label == K.HIGH)])
            sums += own @ reach
            counts += own.sum(1)
        yield pd.DataFrame(
            {"v": np.arange(w.shape[1]), "low": sums[0], "high": sums[1], "nl": int(counts[0]), "nh": int(counts[1])}
        )

    sums = rows.select(*_P, "__n", "label").mapInPandas(run, "v int, low double, high double, nl long, nh long")
    means = sums.groupBy("v").agg(
        F.try_divide(F.sum("low"), F.sum("nl")).alias("low_mean"),
        F.try_divide(F.sum("high"), F.sum("nh")).alias("high_mean"),
    )
    return means.withColumn("gap", F.col("low_mean") - F.col("high_mean"))


def closure_table(
    seeds: DataFrame, vectors: Sequence[dict[str, float]], baseline: float = K.BASELINE_EXPOSURES
) -> DataFrame:
    """Gap, closure against published weights, and closure as a share of the floor's."""
    pair = [Regime("additive", "additive"), Regime("floor", "reflective_floor")]
    anchors = class_means(with_reach(score_long(seeds, pair, ["label"]), baseline=baseline), ["regime"])
    anchor = anchors.agg(
        F.max(F.when(F.col("regime") == "additive", F.col("gap"))).alias("additive"),
        F.max(F.when(F.col("regime") == "floor", F.col("gap"))).alias("floor"),
    ).select(F.struct("additive", "floor").alias("a")).scalar()
    table = vector_table(seeds.sparkSession, vectors)
    gaps = vector_gaps(seeds, vectors, baseline)
    closure = F.col("gap") - F.col("__a.additive")
    return (
        table.join(gaps.withColumn("__a", anchor), "v")
        .select(
            *table.columns, "gap", closure.alias("closure"),
            F.try_divide(closure, F.col("__a.floor") - F.col("__a.additive")).alias("closure_of_floor"),
        )
    )


def rank_agreement(seeds: DataFrame, vectors: Sequence[dict[str, float]]) -> DataFrame:
    """Spearman correlation of every vector's score with the published score: rows (v, rho).

    Seeds alike in propensities tie under every vector: they are one row with their number.
    Exact ranks under a vector need all scores under it, and rows times vectors are too many to
    shuffle. So the vectors are spread: each is ranked inside a task, and two numbers a vector
    leave it. Up to ``_SENT_ROWS`` rows of six numbers are sent to every executor once, in pieces
    of which the driver holds one at a time. Only more are scored and shuffled, combined per
    distinct score before they move.
    """
    rows = seeds.groupBy(*_P).agg(F.count(F.lit(1)).alias("n"))
    rows = stage(rows.withColumn("__pub", weighted(K.WEIGHTS, K.HEADS)), "distinct-seeds")
    order = ordered_counts(rows, "__pub", (), {"n": F.sum("n")}).select("__pub", average_rank().alias("rank_pub"))
    ranked = stage(rows.join(order, "__pub").select("rank_pub", *_P, "n"), "published-rank")
    weights = np.array([[v[h] for h in K.HEADS] for v in vectors])
    spark, pieces = seeds.sparkSession, [ranked]
    if not fits_one_task(ranked):
        if ranked.count() > _SENT_ROWS:
            return _shuffled_agreement(ranked, vectors)
        top = ranked.agg(F.max("rank_pub")).first()[0]
        pieces = [ranked.where((F.col("rank_pub") > lo) & (F.col("rank_pub") <= lo + _PIECE)) for lo in range(0, math.ceil(top), _PIECE)]
    sent = [spark.sparkContext.broadcast(np.ascontiguousarray(p.toPandas().to_numpy(np.float64).T)) for p in pieces]

    def run(frames):
        for frame in frames:
            rho = _agreements([p.value for p in sent], weights[frame["id"]])
            yield pd.DataFrame({"v": frame["id"].astype("int32"), "rho": pd.array(rho, "Float64")})

    return spark.range(0, len(vectors), 1, 4 * shuffle_width(spark)).mapInPandas(run, "v int, rho double")


def _agreements(pieces: Sequence[np.ndarray], weights: np.ndarray) -> list[float | None]:
    """Correlation of every vector's average ranks with the first line of ``pieces``; rows count as often as the last one says."""
    y, n = (np.concatenate([p[i] for p in pieces]) for i in (0, -1))
    total = max(n.sum(), 1.0)
    y -= (n * y).sum() / total
    y_norm = np.sqrt((n * y * y).sum())
    y *= n
    out = []
    for w in weights:
        s, at = np.empty(len(n)), 0
        for p in pieces:
            own = s[at : at + p.shape[1]]
            np.multiply(p[1], w[0], out=own)
            for h in range(1, len(_P)):
                own += p[1 + h] * w[h]
            at += p.shape[1]
        order = np.argsort(s)
        s = s[order]
        new = s[1:] != s[:-1]
        if len(s) and np.isnan(s[-1]):
            new &= ~np.isnan(s[:-1])
        at = np.concatenate([[0], np.flatnonzero(new) + 1])[: len(s)]
        tied, own = np.add.reduceat(n[order], at), np.add.reduceat(y[order], at)
        x = np.cumsum(tied) - (tied - 1) / 2.0
        x -= (tied * x).sum() / total
        norm = np.sqrt((tied * x * x).sum()) * y_norm
        out.append(float((x * own).sum() / norm) if norm > 0 else None)
    return out


def closure_intervals(
    seeds: DataFrame, vectors: Mapping[str, dict[str, float]], n: int = 1000, baseline: float = K.BASELINE_EXPOSURES, seed: int = K.SEED,
) -> DataFrame:
    """(name, point, ci_lo, ci_hi): each vector's closure against the published weights, with its paired bootstrap interval.

    Medians are those of the whole pool, which a resample does not change. All vectors are
    columns of one matrix that a batch's draws meet once.
    """
    each = {"published": dict(K.WEIGHTS), **vectors}
    w = np.array([[v[h] for v in each.values()] for h in K.HEADS])
    medians = vector_medians(distinct_rows(seeds), w)  # a number a vector
    reach = [exposure(weighted(v, K.HEADS), F.lit(float(m)), baseline).alias(f"reach{i}") for i, (v, m) in enumerate(zip(each.values(), medians))]
    wide = stage(seeds.select(F.col("id").alias("cascade_id"), "label", *reach), "closure-reach")
    pairs = {name: ("reach0", f"reach{i}") for i, name in enumerate(each)}
    return bootstrap_contrasts(wide, pairs, n, seed).select("name", "point", "ci_lo", "ci_hi").where(F.col("name").isin(list(vectors)))


def _shuffled_agreement(ranked: DataFrame, vectors: Sequence[dict[str, float]]) -> DataFrame:
    cells = ", ".join(
        f"struct({i} as v, " + ", ".join(f"{float(w[h])!r}D as w_{h}" for h in K.HEADS) + ")"
        for i, w in enumerate(vectors)
    )
    rows = ranked.select("rank_pub", *_P, "n", F.inline(F.expr(f"array({cells})")))
    terms = [F.col(f"p_{h}") * F.col(f"w_{h}") for h in K.HEADS]
    long = rows.select("v", "rank_pub", "n", (terms[0] + terms[1] + terms[2] + terms[3]).alias("s"))
    return correlation_with_ranked(long, "s", "rank_pub", ["v"], "n")


def correlation_with_ranked(long: DataFrame, value: str, rank: str, keys: Sequence[str], number: str | None = None) -> DataFrame:
    """Spearman per key when one side already carries its rank.

    The other side's rank is applied to per-value sums, so no join back to rows. ``number``
    names how many rows a row stands for; one by default.
    """
    r, c = F.col(rank), F.col(number) if number else F.lit(1)
    ordered = ordered_counts(
        long, value, keys,
        {"n": F.sum(c), "r1": F.sum(c * r), "r2": F.sum(c * r * r)},
    )
    mine = average_rank()
    sums = ordered.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * mine).alias("x"),
        F.sum(F.col("n") * mine * mine).alias("xx"),
        F.sum("r1").alias("y"),
        F.sum("r2").alias("yy"),
        F.sum(mine * F.col("r1")).alias("xy"),
    )
    n = F.col("n").cast("double")
    num = F.col("xy") - F.col("x") * F.col("y") / n
    den = F.sqrt((F.col("xx") - F.col("x") * F.col("x") / n) * (F.col("yy") - F.col("y") * F.col("y") / n))
    return sums.select(*keys, F.when(den > 0, num / den).alias("rho"))


def closing_region(table: DataFrame, thresholds: Sequence[int] = K.CLOSURE_THRESHOLDS) -> DataFrame:
    """Per threshold: how many vectors reach it, and the one with least fast weight."""
    cells = F.array(
        *[
            F.struct(
                F.lit(t).alias("threshold_pct"),
                (F.col("closure_of_floor") >= F.lit(t / 100.0)).alias("reached"),
            )
            for t in thresholds
        ]
    )
    hit = F.col("reached")
    return (
        table.select("*", F.inline(cells))
        .groupBy("threshold_pct")
        .agg(
            F.sum(F.when(hit, 1).otherwise(0)).alias("n_vectors"),
            F.min(F.when(hit, F.col("fast_share"))).alias("min_fast_share"),
            F.max(F.when(hit, F.col("fast_share"))).alias("max_fast_share"),
            F.min_by(F.when(hit, F.col("v")), F.when(hit, F.struct("fast_share", "v"))).alias("argmin_v"),
        )
    )
