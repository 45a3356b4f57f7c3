import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.columns import interval_bucket, literal_doubles
from tidemark.operators import profiles as P
from tidemark.operators import ranks as R
from tidemark.operators import sampling as A
from tidemark.operators.joins import lookup, one_to_one


@pytest.fixture(scope="module")
def posts(spark):
    n = 900
    pdf = pd.DataFrame({"id": np.arange(n), "stratum": np.where(np.arange(n) < 300, 1, np.arange(n) % 7)})
    return spark.createDataFrame(pdf)


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("per_range", [60, 10**9])
def test_samples_ignore_partitioning(posts, monkeypatch, per_range):
    monkeypatch.setattr(R, "ROWS_PER_RANGE", per_range)
    a, b = ids(A.sample_rows(posts.repartition(1), 100, "id")), ids(A.sample_rows(posts.repartition(9), 100, "id"))
    assert a == b and len(set(a)) == 100
    assert ids(A.sample_rows(posts, 100, "id", seed=1)) != a


def test_sample_is_even(posts):
    hits = np.zeros(900)
    for seed in range(12):
        hits[ids(A.sample_rows(posts, 300, "id", seed))] += 1
    assert 0.28 < hits[:450].mean() / 12 < 0.39


def test_short_pool_repeats(posts):
    few = posts.where("id < 7")
    out = A.sample_rows(few, 20, "id")
    counts = pd.Series(ids(out)).value_counts()
    assert out.count() == 20 and set(counts) == {2, 3}
    with pytest.raises(ValueError):
        A.sample_rows(posts, 0, "id")


def test_label_samples(spark):
    rows = [(i, K.LOW if i < 10 else K.HIGH if i < 100 else None if i < 150 else K.MIXED, "x" * (i % 60)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, credibility_label string, t string")
    got = A.label_sample(df, 30, "id").groupBy("credibility_label").count().collect()
    assert {r[0]: r[1] for r in got} == {K.LOW: 30, K.HIGH: 30}
    assert all(100 <= i < 150 for i in ids(A.unlabelled_sample(df, 40, "id")))
    claims = A.claim_sample(df, 500, "id", "t")
    assert claims.where("length(t) < 30").count() == 0 and claims.count() == df.where("length(t) >= 30 and id < 100").count()
    with pytest.raises(ValueError):
        A.label_sample(df.where("id >= 10"), 5, "id")


def test_user_sample_spreads_over_cells(spark):
    rows = [(str(i % 120), float(i), str(i), (i % 120) * 10, i % 2 == 0) for i in range(600)]
    df = spark.createDataFrame(rows, "user_id_str string, epoch double, id_str string, user_followersCount long, user_blue boolean")
    out = A.user_sample(df, 43).toPandas()
    assert len(out) == 43
    per_cell = out.groupby("cell").size().sort_index()
    assert len(per_cell) == 10 and set(per_cell) == {4, 5} and list(per_cell)[:3] == [5, 5, 5]
    flat = df.withColumn("user_followersCount", F.lit(0))
    assert A.user_sample(flat, 50).select("cell").distinct().count() == 10


def test_controls_fall_back_one_bin(spark):
    pool = [(i, 2, True) for i in range(50)] + [(i, 3, True) for i in range(50, 53)]
    cases = [(100, 2, True), (101, 4, True), (102, 9, True)]
    df = spark.createDataFrame(pool + cases, "id long, b long, o boolean")
    out = A.matched_controls(df, df.where("id >= 100"), "id", "b", ["o"]).toPandas()
    assert not set(out["id"]) & {100, 101, 102}
    assert (out["b"] == 2).sum() == 10 and (out["b"] == 3).sum() == 3 and len(out) == 13


def test_bins(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.0, 3.0, 9.0, None)], "v double")
    edges = literal_doubles([1.0, 2.0, 3.0])
    left = [r[0] for r in df.select(interval_bucket(F.col("v"), edges, "left")).collect()]
    right = [r[0] for r in df.select(interval_bucket(F.col("v"), edges, "right")).collect()]
    assert left == [0, 0, 0, 1, 1, 1, 1] and right == [None, 0, 0, 0, 1, None, None]
    constant = spark.createDataFrame([(2.0,)] * 5, "v double")
    assert {r["bin"] for r in A.quantile_bins(constant, "v").collect()} == {0}
    empty = spark.createDataFrame([(None,)], "v double")
    assert A.quantile_bins(empty, "v").first()["bin"] == 0


def test_bins_partition_rows_like_numpy(spark):
    x = np.random.default_rng(0).exponential(size=1000).round(1)
    out = A.quantile_bins(spark.createDataFrame(pd.DataFrame({"v": x})), "v").toPandas()
    edges = np.unique(np.quantile(x, np.linspace(0, 1, 6)))
    want = np.clip(np.searchsorted(edges, out["v"], side="right") - 1, 0, len(edges) - 2)
    assert (out["bin"] == want).all()


def test_folds_and_split(posts):
    out = A.stratified_folds(posts, "id", "stratum").toPandas()
    spread = out.groupby(["stratum", "fold"]).size().unstack()
    assert (spread.max(axis=1) - spread.min(axis=1)).max() <= 1
    assert A.train_split(posts, "id").where("is_val").count() == 90


@pytest.mark.parametrize("repeats", [1, 7])
def test_a_split_needs_no_ranks(spark, monkeypatch, repeats):
    from tidemark.plans.models import _beyond

    rows = spark.range(1000).selectExpr(f"cast(id / {repeats} as long) as id")
    want = [(r["id"], r["sample_rank"] <= 100) for r in A.sample_order(rows, "id", 5).collect()]
    ranked = R.attach_ranks(rows.withColumn("h", A.hash_order(F.col("id"), 5)), {"h": "r"}).where("r > 100").count()
    kept = rows.withColumn("h", A.hash_order(F.col("id"), 5))
    assert kept.where(_beyond(kept, {"m": "h"}, 100)["m"]).count() == ranked
    if repeats == 1:
        monkeypatch.setattr(A, "sample_order", None)
    assert sorted((r["id"], r["is_val"]) for r in A.train_split(rows, "id", 0.1, 5).collect()) == sorted(want)


def test_decile_composition_takes_exact_tenth(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS_PER_RANGE", 30)
    rows = [(i, "a" if i % 3 else "b", 1.0 if i < 60 else 0.0) for i in range(105)]
    out = P.decile_composition(spark.createDataFrame(rows, "id long, g string, v double"), "v", "g", "id").toPandas()
    assert out["n_top"].sum() == 10 and out["baseline_share"].sum() == pytest.approx(1)
    want = sorted(i for i in range(60))[-10:]
    assert out.set_index("g")["n_top"].to_dict() == {"a": sum(i % 3 > 0 for i in want), "b": sum(i % 3 == 0 for i in want)}


def test_diurnal_weights(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (3600.0 * 25,), (None,)], "epoch double")
    got = {r["hour"]: r["weight"] for r in P.diurnal_weights(df).collect()}
    assert len(got) == 24 and got[0] == 16.0 and got[1] == 8.0 and sum(got.values()) == 24.0
    empty = P.diurnal_weights(df.where("epoch < 0")).collect()
    assert {r["weight"] for r in empty} == {1.0} and len(empty) == 24


def test_join_checks(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, 5), (1, 3), (9, 1)], "k int, o int")
    with pytest.raises(ValueError):
        one_to_one(a, b, ["k"])
    assert one_to_one(a, b.where("o = 5"), ["k"]).count() == 1
    got = {r["k"]: r["o"] for r in lookup(a, b, "k", ["o"]).collect()}
    assert got == {1: 3, 2: None}
    with pytest.raises(ValueError):
        lookup(a, b, "k", ["o"], required=True)
