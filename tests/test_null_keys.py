"""Groups without a key keep their place in ranks, at every size."""

import pytest

from pyspark.sql import functions as F

from tidemark.operators import ranks, sampling
from tidemark.operators.profiles import numeric_profile
from tidemark.streaming import jobs


@pytest.mark.parametrize("rows_per_range", [4, 1_000_000])
def test_null_groups_are_counted_and_ranked(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(ranks, "ROWS_PER_RANGE", rows_per_range)
    df = spark.createDataFrame([(i, "a" if i % 3 else None, float(i)) for i in range(30)], "id long, g string, v double")
    counted = ranks.ordered_counts(df, "v", ["g"])
    assert counted.count() == 30 and {r["tot_n"] for r in counted.where("g is null").collect()} == {10}


def test_deviation_of_epoch_sized_values(spark):
    df = spark.createDataFrame([(1.7e12,), (1.7e12 + 1,), (1.7e12 + 2,)], "v double")
    assert numeric_profile(df, ["v"]).first()["std"] == pytest.approx(1.0)


def _rows(spark):
    return spark.createDataFrame(
        [(None if i % 7 == 0 else i, None if i % 3 == 0 else "a", i) for i in range(30)], "id long, g string, v long")


def test_samples_keep_null_keys_and_strata(spark):
    rows = _rows(spark)
    drawn = sampling.stratified_sample(rows, 100, "id", ["g"], replacement=False)
    assert sorted(r["v"] for r in drawn.collect()) == list(range(30))
    split = sampling.train_split(rows, "id").collect()
    assert len(split) == 30 and sum(r["is_val"] for r in split) == 3
    assert sampling.stratified_folds(rows, "id", "g").count() == 30


def test_controls_match_on_null_columns(spark):
    posts = spark.createDataFrame([(i, 1 if i < 20 else None, None if i % 2 else "x") for i in range(40)], "id long, s int, g string")
    cases = posts.where(F.col("id").isin(1, 21))
    drawn = sampling.matched_controls(posts, cases, "id", "s", ["g"], per_case=2).collect()
    assert sorted((r["s"] is None, r["g"]) for r in drawn) == [(False, None)] * 2 + [(True, None)] * 2


def test_stream_of_a_table_folder_counts_late_rows(spark, tmp_path):
    hours = [50, 60, 1, 2]  # later files are days older
    rows = [(f"2024-01-0{1 + h // 24} {h % 24:02d}:10:00", "k") for h in hours for _ in range(10)]
    for part in range(4):
        df = spark.createDataFrame(rows[10 * part : 10 * part + 10], "ts string, kind string").select(F.to_timestamp("ts").alias("ts"), "kind")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    events = jobs.read_table_files(spark, str(tmp_path), "events.parquet", df.schema)
    out = str(tmp_path / "out")
    jobs.run_to_end(events, out, str(tmp_path / "state"), per_batch=lambda b: jobs.hourly_counts(b, "ts", "kind", None))
    counted = jobs.added(spark, out, ["hour_start", "kind"], ["n"]).collect()
    assert sorted(r["n"] for r in counted) == [10] * 4
