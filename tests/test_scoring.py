import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions import features as X
from tidemark.functions import scoring as S
from tidemark.operators import reach as R
from tidemark.operators import weightgrid as W


@pytest.fixture(scope="module")
def seeds(spark):
    rng = np.random.default_rng(2)
    n = 3001
    pdf = pd.DataFrame(rng.random((n, 4)).round(3), columns=[f"p_{h}" for h in K.HEADS])
    pdf.loc[: n // 3, "p_reply"] = 0.25
    pdf["id"] = np.arange(n)
    pdf["label"] = np.array([K.LOW, K.HIGH, None], dtype=object)[pdf["id"] % 3]
    return pdf, spark.createDataFrame(pdf).repartition(5)


def one(spark, regime, reply, retweet, like, deep):
    df = spark.createDataFrame([(reply, retweet, like, deep)], "p_reply double, p_retweet double, p_like double, p_deep double")
    a = df.select(regime.score()).first()[0]
    b = S.score_long(df, [regime], []).first()["score"]
    assert a == b
    return a


def test_forms_by_hand(spark):
    assert one(spark, S.Regime("a", "additive"), 0.1, 0.2, 0.4, 0.5) == pytest.approx(1.35 + 0.2 + 0.2 + 1.0)
    assert one(spark, S.Regime("g", "ablated"), 0.0, 0.9, 0.9, 0.0) == 0.0
    low = one(spark, S.Regime("g", "ablated"), 0.1, 0.1, 0.1, 0.1)
    assert one(spark, S.Regime("g", "ablated"), 0.1, 0.9, 0.1, 0.1) > low
    assert one(spark, S.Regime("g", "ablated", alpha=0.0), 0.1, 0.9, 0.9, 0.1) == pytest.approx(1.55)
    assert one(spark, S.Regime("r", "ratio_correction"), 0.1, 0.9, 0.9, 0.1) < one(spark, S.Regime("a", "additive"), 0.1, 0.9, 0.9, 0.1)
    assert one(spark, S.Regime("f", "reflective_floor", floor=5.0, floor_scale=0.1), 0.1, 0.9, 0.9, 0.1) < 1e-6
    assert one(spark, S.Regime("p", "fast_floor", floor=0.0), 0.1, 0.0, 0.0, 0.0) == pytest.approx(1.35 * 0.5)
    assert one(spark, S.Regime("c", "complementary"), 0.1, 0.2, 0.2, 0.1) == pytest.approx(1.55**0.75 * 0.3**0.25)
    retuned = S.default_regimes()[2]
    assert one(spark, retuned, 0.1, 0.0, 0.0, 0.0) == pytest.approx(0.675)
    assert one(spark, S.Regime("m", "additive", multiplier=2.0), 0.1, 0.0, 0.0, 0.0) == pytest.approx(2.7)


def test_bad_regimes(spark):
    with pytest.raises(ValueError):
        S.Regime("x", "unheard_of").score()
    for form in ("ablated", "ratio_correction", "fast_floor"):
        with pytest.raises(ValueError):
            S.Regime("x", form, fast=()).score()
    with pytest.raises(ValueError):
        S.regime_rows([S.Regime("x", "reflective_floor", slow=())])


def test_long_scores_equal_columns(seeds):
    _, df = seeds
    regimes = S.all_regimes() + S.partition_regimes()
    wide = S.with_scores(df, regimes).toPandas().set_index("id")
    long = S.score_long(df, regimes, ["id"]).toPandas().pivot(index="id", columns="regime", values="score")
    for r in regimes:
        assert np.array_equal(wide[f"score_{r.name}"], long[r.name].loc[wide.index])


def test_reach_is_scale_free(seeds):
    _, df = seeds
    base = [S.Regime("a", "additive")]
    doubled = [S.Regime("a", "additive", weights={h: 2 * w for h, w in K.WEIGHTS.items()})]
    a = R.with_reach(S.score_long(df, base, ["id"])).orderBy("id").toPandas()
    b = R.with_reach(S.score_long(df, doubled, ["id"])).orderBy("id").toPandas()
    assert np.allclose(a["reach"], b["reach"])
    assert np.median(a["rel_score"]) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        R.score_reference(S.score_long(df, base, ["id"]), mode="mode")


def test_unusable_reference_gives_baseline(spark):
    df = spark.createDataFrame([("z", 0.0), ("z", 0.0), ("z", 3.0)], "regime string, score double")
    assert {r["reach"] for r in R.with_reach(df).collect()} == {200.0}


def test_plan_sums_to_reach(seeds, spark):
    _, df = seeds
    rows = df.select("id", (F.col("id") * 1800.0).alias("epoch"), F.lit(50.0).alias("reach"))
    weights = spark.createDataFrame([(h, 1.0 + (h % 5)) for h in range(24)], "hour int, weight double")
    for circadian in (True, False):
        plan = R.hourly_plan(rows, weights, circadian=circadian, keep=["id"])
        sums = plan.groupBy("id").agg(F.sum("planned").alias("s"), F.count("*").alias("n")).toPandas()
        assert np.allclose(sums["s"], 50.0) and (sums["n"] == 24).all()


@pytest.mark.parametrize("fetch", [W._FETCH, 4])
def test_vector_medians_and_gaps(seeds, monkeypatch, fetch):
    monkeypatch.setattr(W, "_FETCH", fetch)
    pdf, df = seeds
    vectors = [*W.named_weights().values(), *W.weight_grid()[::97]]
    w = np.array([[v[h] for v in vectors] for h in K.HEADS])
    scores = pdf[[f"p_{h}" for h in K.HEADS]].to_numpy() @ w
    med = W.vector_medians(df, w)
    assert np.allclose(med, np.median(scores, axis=0), rtol=1e-12)
    got = W.vector_gaps(df, vectors, 200.0).toPandas().sort_values("v")["gap"].to_numpy()
    reach = np.clip(200 * np.where(med > 0, scores / np.where(med > 0, med, 1), 1), 0, 50000)
    low, high = (pdf["label"] == K.LOW).to_numpy(), (pdf["label"] == K.HIGH).to_numpy()
    assert np.allclose(got, reach[low].mean(0) - reach[high].mean(0))
    rho = W.rank_agreement(df, vectors).toPandas().sort_values("v")["rho"].to_numpy()
    want = [pd.Series(scores[:, i].round(12)).rank().corr(pd.Series(scores[:, 0].round(12)).rank()) for i in range(len(vectors))]
    assert np.allclose(rho, want, atol=1e-4)


def test_grid_size():
    assert len(W.weight_grid()) == 2128
    assert all(abs(sum(v.values()) - 1) < 1e-12 for v in W.weight_grid())


def test_feature_edges(spark):
    rows = [(None, 0, None, None, None, None, None, [], None, None, None, "1960-01-01 00:00:00")]
    df = spark.createDataFrame(
        rows,
        "user_followersCount long, user_friendsCount long, user_statusesCount long, user_favouritesCount long, user_listedCount long,"
        " epoch double, rawContent string, link_urls array<string>, user_blue boolean, is_reply boolean, is_quote boolean, user_created_at string",
    )
    row = X.extract_features(df).first().asDict()
    assert tuple(row) == K.FEATURES and row.pop("hour_cos") == 1.0 and row.pop("weekhour_cos") == 1.0
    assert set(row.values()) == {0.0}
    scaled = X.apply_scaler(X.extract_features(df), X.scaler_stats(X.extract_features(df))).first()
    assert scaled["log_followers"] == 0.0


def test_repeated_seeds_are_scored_once(seeds, spark, monkeypatch):
    pdf, df = seeds
    vectors = [*W.named_weights().values(), *W.weight_grid()[::211]]
    w = np.array([[v[h] for v in vectors] for h in K.HEADS])
    many = df.crossJoin(spark.range(3))
    assert W.distinct_rows(many, ["label"]).count() <= len(pdf)
    assert np.allclose(W.vector_medians(many, w), np.median((pd.concat([pdf] * 3)[[f"p_{h}" for h in K.HEADS]].to_numpy() @ w), axis=0), rtol=1e-12)
    monkeypatch.setattr("tidemark.operators.ranks.ROWS_PER_RANGE", 2 * len(pdf))  # three copies are more, the distinct rows fewer
    monkeypatch.setattr(W, "_shuffled_agreement", None)
    once = {r["v"]: r["rho"] for r in W.rank_agreement(df, vectors).collect()}
    thrice = {r["v"]: r["rho"] for r in W.rank_agreement(many, vectors).collect()}
    # Ranks of copies spread evenly: the correlation of ranks is the same.
    assert once.keys() == thrice.keys() and all(abs(once[v] - thrice[v]) < 1e-9 for v in once)


@pytest.mark.parametrize("sample", [16, 50])
def test_medians_hold_where_the_guess_misses(spark, monkeypatch, sample):
    monkeypatch.setattr(W, "_SAMPLE", sample)
    monkeypatch.setattr(W, "_FETCH", 8)
    monkeypatch.setattr(W, "_guess", lambda p, w, n: (np.full(w.shape[1], 5.0), np.full(w.shape[1], 6.0))) if sample == 16 else None
    rng = np.random.default_rng(3)
    p = np.round(rng.random((3001, 4)) ** 3, 2)
    w = np.array([[v[h] for v in W.weight_grid()[::97]] for h in K.HEADS])
    df = spark.createDataFrame(pd.DataFrame(p, columns=[f"p_{h}" for h in K.HEADS]))
    assert np.allclose(W.vector_medians(df, w), np.median(p @ w, axis=0), rtol=1e-12)
