"""Score forms as Column expressions over ``p_reply, p_retweet, p_like, p_deep``."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as K


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def weighted(weights: Mapping[str, float], heads: Iterable[str]) -> Column:
    """Sum of weight times propensity over ``heads``, in head order."""
    terms = [F.lit(float(weights[h])) * F.col(f"p_{h}") for h in K.HEADS if h in set(heads)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


@dataclass(frozen=True)
class Regime:
    """One way to turn four propensities into a score."""

    name: str
    form: str
    weights: Mapping[str, float] = field(default_factory=lambda: dict(K.WEIGHTS))
    alpha: float = 1.0
    slow: tuple[str, ...] = K.SLOW_HEADS
    fast: tuple[str, ...] = K.FAST_HEADS
    floor: float = K.FLOOR
    floor_scale: float = K.FLOOR_SCALE
    exponent: float = 0.75
    multiplier: float = 1.0

    def _class_sum(self, heads: tuple[str, ...], which: str) -> Column:
        kept = [h for h in heads if h in self.weights]
        if not kept:
            raise ValueError(f"{self.name}: no {which} heads among the weights")
        return weighted(self.weights, kept)

    @property
    def slow_sum(self) -> Column:
        return self._class_sum(self.slow, "slow")

    @property
    def fast_sum(self) -> Column:
        return self._class_sum(self.fast, "fast")

    def score(self) -> Column:
        """The score Column, times the regime's multiplier."""
        plain = weighted(self.weights, self.weights)
        scale = max(self.floor_scale, K.RATIO_EPS)
        if self.form == "additive":
            out = plain
        elif self.form == "ablated":
            out = self.slow_sum * (F.lit(1.0) + F.lit(self.alpha) * self.fast_sum)
        elif self.form == "ratio_correction":
            ratio = self.fast_sum / (self.slow_sum + F.lit(K.RATIO_EPS))
            out = plain / (F.lit(1.0) + F.lit(self.alpha) * ratio)
        elif self.form == "reflective_floor":
            out = plain * sigmoid((self.slow_sum - F.lit(self.floor)) / F.lit(scale))
        elif self.form == "fast_floor":
            out = plain * sigmoid((self.fast_sum - F.lit(self.floor)) / F.lit(scale))
        elif self.form == "complementary":
            slow = F.greatest(self.slow_sum, F.lit(K.GEOMETRIC_EPS))
            fast = F.greatest(self.fast_sum, F.lit(K.GEOMETRIC_EPS))
            out = F.pow(slow, F.lit(self.exponent)) * F.pow(fast, F.lit(1.0 - self.exponent))
        elif self.form == "floor_x_substance":
            gate = sigmoid((self.slow_sum - F.lit(self.floor)) / F.lit(scale))
            out = plain * gate * sigmoid(F.col("z_substance"))
        else:
            raise ValueError(f"unknown score form {self.form!r}")
        return out if self.multiplier == 1.0 else out * F.lit(self.multiplier)


def default_regimes() -> list[Regime]:
    halved = dict(K.WEIGHTS, reply=K.WEIGHTS["reply"] / 2.0)
    return [
        Regime("additive", "additive"),
        Regime("ablated", "ablated"),
        Regime("additive_retuned", "additive", weights=halved),
    ]


def robustness_regimes() -> list[Regime]:
    return [
        Regime("ratio_correction", "ratio_correction"),
        Regime("reflective_floor", "reflective_floor"),
    ]


def all_regimes() -> list[Regime]:
    return default_regimes() + robustness_regimes() + [
        Regime("fast_floor", "fast_floor"),
        Regime("complementary", "complementary"),
        Regime("complementary_even", "complementary", exponent=0.5),
    ]


def partition_regimes(form: str = "ablated") -> list[Regime]:
    """One regime per slow/fast partition variant."""
    return [
        Regime(f"{form}:{name}", form, slow=slow, fast=fast)
        for name, (slow, fast) in K.PARTITIONS.items()
    ]


def with_scores(df: DataFrame, regimes: Iterable[Regime]) -> DataFrame:
    """One ``score_<name>`` column per regime."""
    return df.select("*", *[r.score().alias(f"score_{r.name}") for r in regimes])


def regime_rows(regimes: Iterable[Regime]) -> Column:
    """The regimes as a constant array of structs: names and numbers, no expressions.

    Each head has its weight in the whole, slow and fast sums; a head outside a
    class has weight 0 there.
    """
    rows = []
    for r in regimes:
        r.score()
        cells = [f"'{r.name}' as regime", f"'{r.form}' as form"]
        for prefix, heads in (("w", K.HEADS), ("ws", r.slow), ("wf", r.fast)):
            cells += [
                f"{float(r.weights.get(h, 0.0)) if h in heads else 0.0!r}D as {prefix}_{h}" for h in K.HEADS
            ]
        numbers = {
            "alpha": r.alpha, "floor": r.floor, "scale": max(r.floor_scale, K.RATIO_EPS),
            "exponent": r.exponent, "multiplier": r.multiplier,
        }
        cells += [f"{float(v)!r}D as {n}" for n, v in numbers.items()]
        rows.append(f"struct({', '.join(cells)})")
    return F.expr(f"array({', '.join(rows)})")


def score_long(df: DataFrame, regimes: Iterable[Regime], keep: Iterable[str]) -> DataFrame:
    """One row per (row, regime).

    The regimes are a constant array, so no join is needed, and one expression
    over its numbers serves all of them: generated code does not grow with the
    number of regimes.
    """
    regimes, keep = list(regimes), list(keep)
    extra = [c for c in (*[f"p_{h}" for h in K.HEADS], "z_substance") if c in df.columns and c not in keep]
    rows = df.select(*keep, *extra, F.inline(regime_rows(regimes)))

    def total(prefix: str) -> Column:
        terms = [F.col(f"{prefix}_{h}") * F.col(f"p_{h}") for h in K.HEADS]
        return terms[0] + terms[1] + terms[2] + terms[3]

    rows = rows.select(
        *keep, *[c for c in ("z_substance",) if c in extra],
        "regime", "form", "alpha", "floor", "scale", "exponent", "multiplier",
        total("w").alias("__all"), total("ws").alias("__slow"), total("wf").alias("__fast"),
    )
    c = F.col
    one, eps = F.lit(1.0), F.lit(K.GEOMETRIC_EPS)
    slow_gate = sigmoid((c("__slow") - c("floor")) / c("scale"))
    score = (
        F.when(c("form") == "additive", c("__all"))
        .when(c("form") == "ablated", c("__slow") * (one + c("alpha") * c("__fast")))
        .when(
            c("form") == "ratio_correction",
            c("__all") / (one + c("alpha") * (c("__fast") / (c("__slow") + F.lit(K.RATIO_EPS)))),
        )
        .when(c("form") == "reflective_floor", c("__all") * slow_gate)
        .when(c("form") == "fast_floor", c("__all") * sigmoid((c("__fast") - c("floor")) / c("scale")))
        .when(
            c("form") == "complementary",
            F.pow(F.greatest(c("__slow"), eps), c("exponent")) * F.pow(F.greatest(c("__fast"), eps), one - c("exponent")),
        )
    )
    if any(r.form == "floor_x_substance" for r in regimes):
        score = score.when(c("form") == "floor_x_substance", c("__all") * slow_gate * sigmoid(c("z_substance")))
    return rows.select(*keep, "regime", (score * c("multiplier")).alias("score"))


def mechanism(df: DataFrame) -> DataFrame:
    """Slow and fast sums, fast share, ratio, floor gate and score multipliers."""
    forms = {r.name: r for r in default_regimes() + robustness_regimes()}
    out = df.select(
        "*",
        weighted(K.WEIGHTS, K.SLOW_HEADS).alias("s_slow"),
        weighted(K.WEIGHTS, K.FAST_HEADS).alias("s_fast"),
        *[forms[n].score().alias(f"score_{n}") for n in ("additive", "ablated", "reflective_floor")],
    )
    eps = F.lit(K.MULTIPLIER_EPS)
    total = F.col("s_slow") + F.col("s_fast")
    return out.select(
        "*",
        F.when(total != 0, F.col("s_fast") / total).alias("fast_share"),
        sigmoid((F.col("s_slow") - F.lit(K.FLOOR)) / F.lit(K.FLOOR_SCALE)).alias("gate"),
        (F.col("score_ablated") / (F.col("score_additive") + eps)).alias("mult_ablated"),
        (F.col("score_reflective_floor") / (F.col("score_additive") + eps)).alias("mult_floor"),
    )


def reactive_ratio(eps: float) -> Column:
    """Fast over slow propensity mass; ``eps`` smooths the denominator."""
    return (F.col("p_retweet") + F.col("p_like")) / (
        F.col("p_reply") + F.col("p_deep") + F.lit(float(eps))
    )


def reflective_ratio(eps: float) -> Column:
    return (F.col("p_reply") + F.col("p_deep")) / (
        F.col("p_retweet") + F.col("p_like") + F.lit(float(eps))
    )
