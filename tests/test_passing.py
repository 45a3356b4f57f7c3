"""Parts of a job leave no tables behind, and grouping a query's forms leaves its rows as they are."""

from pathlib import Path

from tidemark.plans import load, ranking
from tidemark.session import passing, stage, stage_root


def staged(spark):
    return {p.name for p in Path(stage_root(spark).removeprefix("file:")).glob("stage/*")}


def test_tables_staged_inside_are_removed(spark):
    kept = stage(spark.range(5), "kept")
    before = staged(spark)
    with passing(spark):
        inner = stage(kept.selectExpr("id % 2 as k").groupBy("k").count(), "inner")
        assert inner.count() == 2 and len(staged(spark)) == len(before) + 1
    assert staged(spark) == before and kept.count() == 5


def test_frontier_a_form_at_a_time_is_the_same_and_keeps_no_cells(spark, monkeypatch):
    """All forms' tables lay on the disk at once: 1.5 GB at 0.075 GB of input."""
    run = load()["frontier"].run
    whole = sorted(map(tuple, run(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(ranking, "_CELL_ROWS", 1)
    before = staged(spark)
    assert sorted(map(tuple, run(spark, "/root/testdata/sf0.001").collect())) == whole and len(whole) == 11
    assert not any(name.startswith(("forms", "cells")) for name in staged(spark) - before)
