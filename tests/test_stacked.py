import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidemark.operators import stacked


def test_stacked_fits_equal_fits_one_by_one(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 3)) * [1.0, 40.0, 0.2] + [0.0, 1000.0, 3.0]
    z = x[:, 0] - (x[:, 1] - 1000) / 40 + rng.standard_normal(600)
    pdf = pd.DataFrame(x, columns=["log_followers", "log_friends", "has_url"])
    pdf["y_a"], pdf["y_b"] = (z > 0).astype(float), (z + x[:, 2] > 3.3).astype(float)
    pdf["s1"], pdf["s2"], pdf["none"] = np.arange(600) % 3 > 0, np.arange(600) % 2 > 0, False
    df = spark.createDataFrame(pdf).repartition(5)
    names = ["log_followers", "log_friends", "has_url"]
    fits = [(s, y) for s in ("s1", "s2", "none") for y in ("y_a", "y_b")]
    models = stacked.fit_stacked(df, names, fits)
    assert not models["none", "y_a"].any()
    for s, y in fits[:4]:
        part = pdf[pdf[s]]
        scaled = part[names].to_numpy().copy()
        for i in (0, 1):  # the third is a flag and stays as it is
            scaled[:, i] = (scaled[:, i] - scaled[:, i].mean()) / scaled[:, i].std()
        frame = spark.createDataFrame(pd.DataFrame(scaled, columns=names).assign(y=part[y].to_numpy()))
        one = LogisticRegression(maxIter=200, regParam=stacked.RIDGE, standardization=False, tol=1e-12, labelCol="y", featuresCol="f").fit(
            VectorAssembler(inputCols=names, outputCol="f").transform(frame))
        z = scaled @ one.coefficients.toArray() + one.intercept
        own = df.where(F.col(s)).select(*names, stacked.probability(names, models[s, y]).alias("p")).toPandas()
        key = lambda a: np.lexsort(a[:, :2].T)
        plain = part[names].to_numpy()
        assert own["p"].to_numpy()[key(own[names].to_numpy())] == pytest.approx((1 / (1 + np.exp(-z)))[key(plain)], abs=2e-4)


def test_scales_of_subsets_over_many_tasks(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(rng.standard_normal((500, 3)) * [1.0, 5.0, 1.0] + [3.0, 1e6, 0.0], columns=["log_followers", "log_friends", "has_url"])
    pdf["a"], pdf["none"] = np.arange(500) % 3 > 0, False
    df = spark.createDataFrame(pdf).repartition(7)
    got = stacked.subset_scales(df, ["has_url", "log_friends", "log_followers"], ["a", "none"])
    own = pdf[pdf["a"]]
    assert got["a"][0] == pytest.approx([0.0, own["log_friends"].mean(), own["log_followers"].mean()])
    assert got["a"][1] == pytest.approx([1.0, own["log_friends"].std(ddof=0), own["log_followers"].std(ddof=0)])
    assert not got["none"][0].any() and (got["none"][1] == 1).all()
