import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import pvalues
from tidemark.operators import compare as C
from tidemark.operators import ranks as R


def brute_ks(a, b):
    grid = np.union1d(a, b)
    return max(abs((a <= v).mean() - (b <= v).mean()) for v in grid)


def brute_u(a, b):
    return sum((a[:, None] > b[None, :]).sum(1) + 0.5 * (a[:, None] == b[None, :]).sum(1))


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(5)
    a, b = rng.poisson(2, 300).astype(float), rng.poisson(3, 200).astype(float)
    pdf = pd.DataFrame({"v": np.concatenate([a, b]), "side": [True] * 300 + [False] * 200})
    return a, b, spark.createDataFrame(pdf)


@pytest.mark.parametrize("per_range", [50, 10**9])
def test_two_sample_statistics(samples, monkeypatch, per_range):
    monkeypatch.setattr(R, "ROWS_PER_RANGE", per_range)
    a, b, df = samples
    row = C.two_sample(df, "v", "side").first()
    assert row["ks"] == pytest.approx(brute_ks(a, b))
    assert row["u"] == brute_u(a, b)
    assert row["auc"] == pytest.approx(brute_u(a, b) / (300 * 200))
    assert row["median_a"] == np.median(a) and row["p90_b"] == np.quantile(b, 0.9)
    mirrored = C.two_sample(df.withColumn("side", ~F.col("side")), "v", "side").first()
    assert row["u"] + mirrored["u"] == 300 * 200
    assert row["ks"] == pytest.approx(mirrored["ks"])


def test_same_and_different_distributions(spark):
    rng = np.random.default_rng(1)

    def p(a, b):
        pdf = pd.DataFrame({"v": np.concatenate([a, b]).astype(float), "side": [True] * len(a) + [False] * len(b)})
        return C.with_p_values(C.two_sample(spark.createDataFrame(pdf), "v", "side")).first()

    same = p(rng.poisson(2, 500), rng.poisson(2, 500))
    far = p(rng.poisson(1, 500), rng.poisson(20, 500))
    assert same["ks"] < 0.15 and same["ks_p"] > 0.01 and same["mw_p"] > 0.01
    assert far["ks"] > 0.5 and far["ks_p"] < 1e-10 and far["mw_p"] < 1e-10


def test_one_empty_sample_gives_nulls(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True)], "v double, side boolean")
    row = C.two_sample(df, "v", "side").first()
    assert row["n_b"] == 0 and row["u"] is None and row["ks"] is None and row["auc"] is None


def test_known_tail_values(spark):
    # Published tables: t(10) = 2.228 and t(1) = 12.706 leave 5%.
    assert pvalues.t_two_sided_value(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert pvalues.t_two_sided_value(12.70620, 1) == pytest.approx(0.05, abs=1e-6)
    assert pvalues.t_two_sided_value(0.0, 5) == 1.0
    row = spark.range(1).select(
        pvalues.normal_two_sided(F.lit(1.959964)).alias("z"),
        pvalues.kolmogorov_upper(F.lit(1.3581), F.lit(2.0), F.lit(2.0)).alias("k"),
        pvalues.kolmogorov_upper(F.lit(0.0), F.lit(5.0), F.lit(5.0)).alias("zero"),
    ).first()
    assert row["z"] == pytest.approx(0.05, abs=1e-6)
    assert row["k"] == pytest.approx(0.05, abs=1e-4) and row["zero"] == 1.0
    # Both forms of the series agree where they meet.
    near = spark.range(1).select(
        pvalues.kolmogorov_upper(F.lit(0.999999), F.lit(2.0), F.lit(2.0)).alias("a"),
        pvalues.kolmogorov_upper(F.lit(1.000001), F.lit(2.0), F.lit(2.0)).alias("b"),
    ).first()
    assert near["a"] == pytest.approx(near["b"], abs=1e-5)


def test_spearman_and_partial(spark):
    rng = np.random.default_rng(8)
    z = rng.normal(size=400)
    pdf = pd.DataFrame({"x": np.round(z + rng.normal(size=400), 1), "y": np.round(z + rng.normal(size=400), 1), "z": z})
    df = spark.createDataFrame(pdf)
    r = pdf.rank()
    c = r.corr()
    row = C.spearman(df, "x", "y", p_value=True).first()
    assert row["rho"] == pytest.approx(c.loc["x", "y"])
    assert 0 <= row["p_value"] < 0.05
    part = C.partial_spearman(df, "x", "y", "z", p_value=True).first()
    want = (c.loc["x", "y"] - c.loc["x", "z"] * c.loc["y", "z"]) / math.sqrt((1 - c.loc["x", "z"] ** 2) * (1 - c.loc["y", "z"] ** 2))
    assert part["partial_xy_z"] == pytest.approx(want)
    assert C.partial_spearman(df.withColumn("z", F.col("x")), "x", "y", "z").first()["partial_xy_z"] is None


def test_average_precision_by_hand(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, False), (0.7, True), (0.7, False), (0.1, False)], "s double, y boolean")
    # Steps: 1/2 at precision 1, 1/2 at precision 2/4.
    assert C.average_precision(df, "s", "y").first()["average_precision"] == pytest.approx(0.5 + 0.25)


def test_kappa(spark):
    df = spark.createDataFrame([("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15, "a string, b string")
    row = C.cohen_kappa(df, "a", "b").first()
    assert row["agreement"] == pytest.approx(0.7) and row["kappa"] == pytest.approx(0.4)
    assert C.cohen_kappa(df.where("a = 'y' and b = 'y'"), "a", "b").first()["kappa"] is None
    assert C.cohen_kappa(df.where("a = 'q'"), "a", "b").first()["kappa"] is None
