import numpy as np
import pandas as pd
import pytest

from tidemark.operators import ranks as R

PROBES = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.95, "e": 1.0}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 4000
    # A third of the rows share one value, and some are missing.
    x = np.where(rng.random(n) < 0.35, 0.0, np.round(rng.normal(size=n), 2))
    x[rng.random(n) < 0.02] = np.nan
    pdf = pd.DataFrame({"id": np.arange(n), "g": rng.integers(0, 3, n), "x": x})
    return pdf, spark.createDataFrame(pdf)


@pytest.fixture(params=[200, 10**9], ids=["ranged", "small"])
def rows_per_range(request, monkeypatch):
    monkeypatch.setattr(R, "ROWS_PER_RANGE", request.param)


def test_average_ranks_match_pandas(data, rows_per_range):
    pdf, df = data
    out = R.attach_ranks(df, {"x": "r"}).toPandas().sort_values("id")
    assert np.allclose(out["r"], pdf["x"].rank(), equal_nan=True)


def test_keyed_percent_ranks_match_pandas(data, rows_per_range):
    pdf, df = data
    out = R.attach_ranks(df, {"x": "r"}, "percent", ["g"]).toPandas().sort_values("id")
    want = pdf.groupby("g")["x"].transform(lambda v: 100 * (v.rank() - 1) / (v.count() - 1))
    assert np.allclose(out["r"], want, equal_nan=True)


def test_unit_rank_ignores_partitioning(data, rows_per_range):
    _, df = data
    a = R.attach_ranks(df.repartition(1), {"x": "r"}, "unit").toPandas().sort_values("id")
    b = R.attach_ranks(df.repartition(7), {"x": "r"}, "unit").toPandas().sort_values("id")
    assert np.array_equal(a["r"], b["r"], equal_nan=True)


def test_exact_quantiles_match_numpy(data, rows_per_range):
    pdf, df = data
    keyed = R.exact_quantiles(df, "x", PROBES, ["g"]).toPandas().sort_values("g")
    want = pdf.groupby("g")["x"].quantile(list(PROBES.values())).unstack()
    assert np.allclose(keyed[list(PROBES)], want)
    assert list(keyed["n"]) == list(pdf.groupby("g")["x"].count())
    whole = R.exact_quantiles(df, "x", PROBES).first()
    assert np.allclose([whole[c] for c in PROBES], pdf["x"].dropna().quantile(list(PROBES.values())))


def test_quantiles_keep_a_null_key(spark, rows_per_range):
    rows = [(None, float(i)) for i in range(301)] + [("k", float(i)) for i in range(101)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r["m"] for r in R.exact_quantiles(df, "x", {"m": 0.5}, ["g"]).collect()}
    assert got == {None: 150.0, "k": 50.0}


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "x double")
    assert R.exact_quantiles(df, "x", {"m": 0.5}).first()["m"] is None


def test_ranges_give_the_same_counts_at_any_partition_count(data, monkeypatch):
    """Ranges come from a range exchange now; cut points are no longer looked up."""
    pdf, df = data
    found = []
    for size, parts in ((7, 1), (60, 9), (10**9, 3)):
        monkeypatch.setattr(R, "ROWS_PER_RANGE", size)
        found.append(R.ordered_counts(df.repartition(parts), "x").toPandas().sort_values("x").to_numpy())
    assert all(np.array_equal(found[0], other) for other in found[1:])
    x = pdf["x"].dropna()
    assert found[0][:, 2].tolist() == [float((x <= v).sum()) for v in found[0][:, 0]]



def test_first_by_uses_the_given_order(spark):
    df = spark.createDataFrame([("u", 5, "b"), ("u", 3, "c"), ("v", 1, "a"), ("u", 3, "a")], "k string, e int, id string")
    got = {r["k"]: (r["e"], r["id"]) for r in R.first_by(df, ["k"], ["e", "id"]).collect()}
    assert got == {"u": (3, "a"), "v": (1, "a")}
