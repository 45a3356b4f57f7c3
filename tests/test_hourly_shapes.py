"""Hourly plans look one of 24 shapes up; no seed computes its own."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import reach as R


def test_shapes_are_looked_up_and_equal_those_by_seed(spark):
    weight = [0.5 + (7 * h % 24) / 12.0 for h in range(24)]
    weights = spark.createDataFrame([(h, w) for h, w in reversed(list(enumerate(weight)))], "hour int, weight double")
    at = {1: 0.0, 2: 86399.9, 3: 1700003600.0, 4: -1.0, 5: 13 * 3600.0, 6: None}
    rows = spark.createDataFrame([(i, e, None if i == 5 else 10.0 * i) for i, e in at.items()], "id int, epoch double, reach double")
    plan = R.hourly_plan(rows, weights, keep=["id"])
    got = {(r["id"], r["t_hour"]): r["planned"] for r in plan.collect()}
    assert len(got) == 6 * 24
    for i, e in at.items():
        if e is None or i == 5:
            assert all(got[i, t] is None for t in range(24))
            continue
        start = math.floor(e / 3600.0) % 24
        parts = [math.exp(-t / 6.0) * weight[(start + t) % 24] for t in range(24)]
        assert [got[i, t] for t in range(24)] == pytest.approx([p / sum(parts) * 10.0 * i for p in parts], rel=1e-14)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    per_seed = [line for line in text.split("\n") if "Subquery" not in line and "epoch" in line]
    assert per_seed and not any("lambda" in line for line in per_seed)
