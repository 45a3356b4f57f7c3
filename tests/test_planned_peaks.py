"""Peak hours from arrays of shares equal those of the exploded hours."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import contrasts as C
from tidemark.plans import load
from tidemark.plans.panel import hourly_panel, panel, plan_shares, shares_from
from tidemark.plans.views import Tables

TABLES = Path("/root/testdata/sf0.001")


def test_ties_take_the_smallest_hour_and_missing_shares_give_hour_0(spark):
    rows = spark.createDataFrame([(10.0, [0.1, 0.4, 0.4, 0.1]), (0.0, [0.1, 0.9]), (5.0, None)], "n double, s array<double>")
    got = [r[0] for r in rows.select(C.planned_peak(F.col("n"), F.col("s"))).collect()]
    assert got == [1, 0, 0]


@pytest.mark.skipif(not TABLES.exists(), reason="given tables")
def test_arrays_equal_the_exploded_plan_and_shuffle_no_panel_rows(spark):
    load()
    t = Tables(spark, str(TABLES))
    rows = panel(t, ["epoch"]).withColumn("shares", shares_from(t, F.col("epoch")))
    mine = rows.select("regime", "replicate", "cascade_id", C.planned_peak(F.col("n_reply"), F.col("shares")).alias("t_peak"))
    old = C.with_peaks(rows, hourly_panel(rows, plan_shares(t))).select(mine.columns)
    assert mine.count() > 0 and mine.exceptAll(old).isEmpty() and old.exceptAll(mine).isEmpty()
    counted = load()["panel_peaks"].run(spark, str(TABLES))
    text = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in text and "sortmergejoin" not in text.lower()
