"""Many logistic fits in one: every pass over the table serves all seeds, corpora and heads.

A fit is a subset of the rows (a boolean column) and a target. A task reads its rows once
and adds up loss, gradient and curvature of every fit at its present weights; the sums, a
few hundred numbers a fit, meet in a keyed aggregate and each fit takes a Newton step. So
twenty fits cost the passes of one. Features are scaled by each subset's own means and
deviations, inside the pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.scoring import sigmoid

PASSES, TOLERANCE, RIDGE = 25, 1e-9, 1e-4


def subset_scales(table: DataFrame, features: Sequence[str], subsets: Sequence[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean and population deviation of each feature over each subset; features that are flags stay as they are."""
    scaled = [f for f in features if f in K.CONTINUOUS_FEATURES]

    def run(frames):
        parts = {}
        for frame in frames:
            x = frame[scaled].to_numpy(np.float64)
            for s in subsets:
                own = x[frame[s].to_numpy(bool)]
                if len(own):
                    mean = own.mean(0)
                    parts[s] = _merged(parts.get(s), (len(own), mean, ((own - mean) ** 2).sum(0)))
        for s, (n, mean, spread) in parts.items():
            yield pd.DataFrame({"s": s, "n": n, "m": [mean.tolist()], "d": [spread.tolist()]})

    each = {}
    if scaled:
        # A row a task and subset.
        for r in table.select(*scaled, *subsets).mapInPandas(run, "s string, n long, m array<double>, d array<double>").collect():
            each[r["s"]] = _merged(each.get(r["s"]), (r["n"], np.array(r["m"]), np.array(r["d"])))
    out = {}
    for s in subsets:
        mean, scale = np.zeros(len(features)), np.ones(len(features))
        if s in each:
            n, means, spread = each[s]
            at = [list(features).index(f) for f in scaled]
            mean[at], scale[at] = means, np.maximum(np.sqrt(spread / n), 1e-6)
        out[s] = mean, scale
    return out


def _merged(a, b):
    """Row number, means and squared deviations of two parts together."""
    if a is None:
        return b
    n, off = a[0] + b[0], b[1] - a[1]
    return n, a[1] + off * (b[0] / n), a[2] + b[2] + off * off * (a[0] * b[0] / n)


def _sums(table: DataFrame, features: Sequence[str], fits: Sequence[tuple[str, str]], scales, weights: np.ndarray) -> np.ndarray:
    """(fit, loss, rows, gradient, curvature) at ``weights``, a row a fit; the last feature is the constant."""
    features, subsets, d = list(features), sorted({s for s, _ in fits}), len(features) + 1
    size = 2 + d + d * d

    def run(frames):
        total = np.zeros((len(fits), size))
        for frame in frames:
            x = frame[features].to_numpy(np.float64)
            for s in subsets:
                rows = frame[s].to_numpy(bool)
                own = np.column_stack([(x[rows] - scales[s][0]) / scales[s][1], np.ones(rows.sum())])
                for k, (subset, target) in enumerate(fits):
                    if subset == s:
                        y = frame[target].to_numpy(np.float64)[rows]
                        z = own @ weights[k]
                        p = 1 / (1 + np.exp(-z))
                        total[k, 0] += (np.logaddexp(0, z) - y * z).sum()
                        total[k, 1] += len(y)
                        total[k, 2 : 2 + d] += own.T @ (p - y)
                        total[k, 2 + d :] += ((own * (p * (1 - p))[:, None]).T @ own).ravel()
        k, at = np.nonzero(total)
        yield pd.DataFrame({"k": k.astype(np.int32), "at": at.astype(np.int32), "v": total[k, at]})

    columns = dict.fromkeys([*features, *subsets, *[t for _, t in fits]])
    got = table.select(*columns).mapInPandas(run, "k int, at int, v double").groupBy("k", "at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((len(fits), size))
    out[got["k"], got["at"]] = got["v"]
    return out


def fit_stacked(table: DataFrame, features: Sequence[str], fits: Sequence[tuple[str, str]], ridge: float = RIDGE,
                passes: int = PASSES) -> dict[tuple[str, str], np.ndarray]:
    """Weights on the features as they are, the constant last, of every (subset column, target column).

    Each minimises the mean log loss of its rows plus ``ridge`` / 2 times the squared weights of
    the scaled features. A step that would raise a fit's loss is halved; a fit without rows
    keeps zero weights. Null features are not expected.
    """
    scales = subset_scales(table, features, sorted({s for s, _ in fits}))
    d = len(features) + 1
    weights, step = np.zeros((len(fits), d)), np.zeros((len(fits), d))
    best = np.full(len(fits), np.inf)
    penalty = np.append(np.ones(d - 1), 0.0)
    for _ in range(passes):
        sums = _sums(table, features, fits, scales, weights)
        moving = False
        for k, row in enumerate(sums):
            n = max(row[1], 1.0)
            loss = row[0] / n + ridge / 2 * (penalty * weights[k] ** 2).sum()
            if loss > best[k] + TOLERANCE:
                step[k] /= 2
                weights[k] -= step[k]
                moving = True
                continue
            moving |= best[k] - loss > TOLERANCE
            best[k] = loss
            gradient = row[2 : 2 + d] / n + ridge * penalty * weights[k]
            curve = row[2 + d :].reshape(d, d) / n + np.diag(ridge * penalty + 1e-12)
            step[k] = -np.linalg.lstsq(curve, gradient, rcond=None)[0] if row[1] else 0.0
            weights[k] = weights[k] + step[k]
        if not moving:
            break
    out = {}
    for k, (subset, target) in enumerate(fits):
        mean, scale = scales[subset]
        plain = (weights[k] - step[k])[:-1] / scale  # of the last weights whose loss is known
        out[subset, target] = np.append(plain, (weights[k] - step[k])[-1] - (plain * mean).sum())
    return out


def probability(features: Sequence[str], weights: np.ndarray) -> Column:
    """The fitted probability as a plain expression."""
    z = F.lit(float(weights[-1]))
    for f, w in zip(features, weights):
        z = z + F.col(f) * F.lit(float(w))
    return sigmoid(z)


def score_variants(table: DataFrame, features: Sequence[str], variants: Mapping[str, str], heads: Sequence[str], models, keep: Sequence[str]) -> DataFrame:
    """(variant, keep..., p_<head>...) of every row under every variant, a name for a subset column."""
    cells = F.array(*[
        F.struct(F.lit(name).alias("variant"), *[probability(features, models[subset, f"y_{h}"]).alias(f"p_{h}") for h in heads])
        for name, subset in variants.items()
    ])
    return table.select(*keep, F.inline(cells))
