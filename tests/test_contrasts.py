import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.operators import contrasts as C


def make_panel(spark, offset=5.0, n=120, reps=4, drop=None, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for regime, shift in (("additive", offset), ("ablated", offset - 2.0), ("additive_retuned", offset)):
        for rep in range(reps):
            for i in range(n):
                label = K.LOW if i % 2 else K.HIGH
                if drop == (regime, rep) and label == K.LOW:
                    continue
                base = 20 + (shift if label == K.LOW else 0) + rng.normal(scale=0.5)
                rows.append((regime, rep, i, label, base, 1.0, 50.0, 2.0, 100.0 + base))
    return spark.createDataFrame(
        pd.DataFrame(rows, columns=["regime", "replicate", "cascade_id", "label", "n_reply", "n_retweet", "n_like", "n_deep", "total_exposures"])
    )


def test_size_leaves_likes_out(spark):
    row = make_panel(spark, n=2, reps=1).select(C.cascade_size().alias("s"), "n_reply").first()
    assert row["s"] == pytest.approx(row["n_reply"] + 3.0)


def test_gaps_and_contrasts(spark):
    gaps = C.replicate_gaps(make_panel(spark), C.cascade_size())
    table = {r["regime"]: r for r in C.regime_gaps(gaps).collect()}
    assert 4 < table["additive"]["mean"] < 6 and table["additive"]["n_low"] == 60
    diff = {r["regime"]: r for r in C.replicate_contrasts(gaps).collect()}
    assert diff["ablated"]["mean"] == pytest.approx(-2.0, abs=0.3) and diff["ablated"]["ci_hi"] < 0
    assert diff["additive_retuned"]["ci_lo"] < 0.2 and set(diff) == {"ablated", "additive_retuned"}


def test_missing_class_is_an_error(spark):
    with pytest.raises(Exception, match="lacks low or high"):
        C.replicate_gaps(make_panel(spark, drop=("ablated", 1)), C.cascade_size()).collect()
    short = make_panel(spark).where("not (regime = 'ablated' and replicate = 3)")
    with pytest.raises(Exception, match="differ in replicates"):
        C.replicate_contrasts(C.replicate_gaps(short, C.cascade_size())).collect()


def test_wide_drops_incomplete_cascades(spark):
    panel = make_panel(spark).where("not (regime = 'ablated' and cascade_id = 7)")
    wide = C.wide_panel(panel, C.cascade_size(), ["additive", "ablated"]).toPandas()
    assert 7 not in set(wide["cascade_id"]) and len(wide) == 119


def test_bootstrap_repeats_and_covers(spark):
    wide = C.wide_panel(make_panel(spark), C.cascade_size(), ["additive", "ablated"])
    a = C.bootstrap_gaps(wide.repartition(1), ["additive", "ablated"], 300).toPandas().sort_values("name")
    b = C.bootstrap_gaps(wide.repartition(6), ["additive", "ablated"], 300).toPandas().sort_values("name")
    assert np.allclose(a[["point", "ci_lo", "ci_hi"]], b[["point", "ci_lo", "ci_hi"]])
    assert ((a["ci_lo"] < a["point"]) & (a["point"] < a["ci_hi"])).all()
    pdf = wide.toPandas()
    low, high = pdf[pdf.label == K.LOW]["additive"], pdf[pdf.label == K.HIGH]["additive"]
    se = np.sqrt(low.var() / len(low) + high.var() / len(high))
    width = a[a.name == "additive"]["ci_hi"].iloc[0] - a[a.name == "additive"]["ci_lo"].iloc[0]
    assert width == pytest.approx(2 * 1.96 * se, rel=0.25)
    pair = C.bootstrap_contrasts(wide, {"ablated": ("additive", "ablated")}, 300).first()
    assert pair["point"] == pytest.approx(-2.0, abs=0.3) and pair["ci_hi"] < 0


def test_bootstrap_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"cascade_id": np.arange(300), "label": np.where(np.arange(300) % 3 == 0, K.LOW, K.HIGH), "v": rng.normal(size=300)})
    got = C.bootstrap_gaps(spark.createDataFrame(pdf).repartition(3), ["v"], 50, seed=9).first()
    w = C.poisson_weights(pdf["cascade_id"].to_numpy(), np.arange(50), 9)
    low = (pdf["label"] == K.LOW).to_numpy()
    v = pdf["v"].to_numpy()
    gaps = (w[low].T @ v[low]) / w[low].sum(0) - (w[~low].T @ v[~low]) / w[~low].sum(0)
    assert got["ci_lo"] == pytest.approx(np.quantile(gaps, 0.025)) and got["ci_hi"] == pytest.approx(np.quantile(gaps, 0.975))


def test_weights_look_poisson():
    w = C.poisson_weights(np.arange(20000), np.arange(40), 1337)
    assert w.mean() == pytest.approx(1.0, abs=0.01) and w.var() == pytest.approx(1.0, abs=0.02)
    assert (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)
    # Means over rows vary between draws as independent weights do.
    assert w.mean(0).std() == pytest.approx(1 / np.sqrt(20000), rel=0.4)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03
    assert abs(np.corrcoef(w[:-1, 0], w[1:, 0])[0, 1]) < 0.03


def test_key_lacking_a_class_has_no_gap(spark):
    df = spark.createDataFrame([(1, "x", K.LOW, 1.0), (2, "x", K.HIGH, 3.0), (3, "y", K.LOW, 1.0)], "cascade_id long, k string, label string, v double")
    got = {r["k"]: r["point"] for r in C.bootstrap_gaps(df, ["v"], 20, keys=["k"]).collect()}
    assert got == {"x": -2.0, "y": None}


def test_peaks_prefer_the_early_hour(spark):
    hourly = spark.createDataFrame([("a", 0, 1, h, n) for h, n in ((0, 1), (1, 4), (2, 4))], "regime string, replicate int, cascade_id int, t_hour int, n_reply int")
    panel = spark.createDataFrame([("a", 0, 1), ("a", 0, 2)], "regime string, replicate int, cascade_id int")
    assert {r["cascade_id"]: r["t_peak"] for r in C.with_peaks(panel, hourly).collect()} == {1: 1, 2: 0}


@pytest.mark.parametrize(
    "main, control, outcome",
    [((-3, -1), (-1, 1), "A"), ((-1, 1), (-1, 1), "B"), ((-3, -1), (-2, -1), "C"), ((1, 2), (0, 1), "D")],
)
def test_decision(spark, main, control, outcome):
    df = spark.createDataFrame([("ablated", *map(float, main)), ("additive_retuned", *map(float, control))], "name string, ci_lo double, ci_hi double")
    assert C.decision(df).first()["outcome"] == outcome
    assert C.decision(df.where("name = 'ablated'")).first()["outcome"] is None


def test_winsorised_copies(spark):
    wide = spark.createDataFrame([(1, K.LOW, 5.0), (2, K.HIGH, 50.0), (3, K.LOW, 500.0)], "cascade_id int, label string, a double")
    caps = F.array(F.struct(F.lit(90).alias("quantile"), F.lit(40.0).alias("cap")), F.struct(F.lit(99).alias("quantile"), F.lit(100.0).alias("cap")))
    clipped = C.winsorized(wide, caps, ["a"])
    got = {(r["quantile"], r["n_low_clipped"], r["n_high_clipped"]) for r in C.clip_counts(clipped, ["a"]).collect()}
    assert got == {(90, 1, 1), (99, 1, 0)}
    assert clipped.agg(F.max("a")).first()[0] == 100.0


def test_shift_words(spark):
    cases = [((-3, -1, -4, -2), "further from 0"), ((-4, -2, -3, -1), "closer to 0"), ((-3, -1, -3.1, -1.1), "similar"), ((-1, 1, -2, -1), "strengthens"), ((-2, -1, -1, 1), "weakens"), ((-2, -1, 1, 2), "reverses"), ((-1, 1, 1, 2), "reverses")]
    for bounds, word in cases:
        assert spark.range(1).select(C.shift_verdict(*[F.lit(float(b)) for b in bounds])).first()[0] == word


def test_deviation_guard(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.5)], "a double, b double")
    assert C.max_deviation(df, F.col("a"), F.col("b"), 1.0).first()[0] == 0.5
    with pytest.raises(Exception, match="deviate"):
        C.max_deviation(df, F.col("a"), F.col("b"), 0.1).collect()
