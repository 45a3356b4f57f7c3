import pytest

from tidemark.operators import cascades as C

SCHEMA = "id_num double, in_reply_to_status_id_str double, conversationId double, epoch double"


def stats(spark, rows, min_size=1, **kw):
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in r) for r in rows], SCHEMA)
    return {r["conversation_id"]: r for r in C.cascade_stats(df, min_size=min_size, **kw).collect()}


STAR = [(1, None, 1, 100), (2, 1, 1, 110), (3, 1, 1, 120), (4, 1, 1, 130)]
CHAIN = [(11, None, 11, 100), (12, 11, 11, 110), (13, 12, 11, 120), (14, 13, 11, 130)]
BRANCH = [(21, None, 21, 1), (22, 21, 21, 2), (23, 21, 21, 3), (24, 22, 21, 4), (25, 22, 21, 5), (26, 23, 21, 6), (27, 26, 21, 7)]
ORPHANS = [(31, None, 31, 1), (32, 31, 31, 2), (33, 99, 31, 3), (34, 99, 31, 4)]
ROOTLESS = [(45, None, 499, 10), (46, 45, 499, 20), (47, 45, 499, 30)]
SINGLE = [(51, None, 51, 100)]
# Post 64 appears twice with different parents; the short way up counts.
TWO_PARENTS = [(61, None, 61, 1), (62, 61, 61, 2), (63, 62, 61, 3), (64, 63, 61, 4), (64, 61, 61, 4), (65, 64, 61, 5)]
CYCLE = [(71, None, 71, 1), (72, 73, 71, 2), (73, 72, 71, 3), (74, 71, 71, 4)]


def shape(r):
    return r["depth"], r["breadth"], r["direct_replies"], r["n_orphans"]


def test_shapes(spark):
    got = stats(spark, STAR + CHAIN + BRANCH + ORPHANS + ROOTLESS + SINGLE + TWO_PARENTS + CYCLE)
    assert shape(got[1.0]) == (1, 3, 3, 0)
    assert shape(got[11.0]) == (3, 1, 1, 0)
    assert shape(got[21.0]) == (3, 3, 2, 0)
    assert shape(got[31.0]) == (1, 1, 1, 2)
    assert got[499.0]["root_id"] == 45.0 and shape(got[499.0]) == (1, 2, 2, 0)
    assert shape(got[51.0]) == (0, 1, 0, 0) and got[51.0]["time_to_peak_seconds"] is None
    assert got[51.0]["duration_seconds"] is None and got[1.0]["duration_seconds"] == 30.0
    assert shape(got[61.0]) == (2, 2, 2, 0)
    assert shape(got[71.0]) == (1, 1, 1, 0)


def test_long_chain_and_wide_star(spark):
    chain = [(1, None, 1, 0)] + [(i, i - 1, 1, i) for i in range(2, 203)]
    star = [(1001, None, 1001, 0)] + [(1001 + i, 1001, 1001, i) for i in range(1, 2000)]
    got = stats(spark, chain + star)
    assert shape(got[1.0]) == (201, 1, 1, 0)
    assert shape(got[1001.0]) == (1, 1999, 1999, 0)


def test_time_to_peak_counts_the_root_hour(spark):
    rows = [(1, None, 1, 0), (2, 1, 1, 1800)] + [(3 + i, 1, 1, 5400) for i in range(5)] + [(20, 1, 1, 10800)]
    assert stats(spark, rows)[1.0]["time_to_peak_seconds"] == 3600.0
    tie = [(1, None, 1, 0), (2, 1, 1, 4000)]
    assert stats(spark, tie)[1.0]["time_to_peak_seconds"] == 0.0
    early = [(1, None, 1, 7200), (2, 1, 1, 100), (3, 1, 1, 200)]
    assert stats(spark, early)[1.0]["time_to_peak_seconds"] == -7200.0


def test_min_size_and_quality(spark):
    assert set(stats(spark, SINGLE + CHAIN[:2], min_size=2)) == {11.0}
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in r) for r in CHAIN[:3] + STAR[:3]], SCHEMA)
    row = C.tree_quality(C.cascade_stats(df)).first()
    assert row["n_cascades"] == 2 and row["share_depth_ge_2"] == 0.5 and row["share_breadth_ge_2"] == 0.5
    empty = C.tree_quality(C.cascade_stats(df, min_size=50)).first()
    assert empty["n_cascades"] == 0 and empty["median_size"] == 0.0


def test_tolerant_root_match(spark):
    big = 1.8e18
    rows = [(big + 4096, None, big, 5), (big + 1024, None, big, 9), (7, None, big, 1)]
    assert stats(spark, rows)[big]["root_id"] == 7.0
    assert stats(spark, rows, rtol=1e-5)[big]["root_id"] == big + 1024


def test_observed_peak_drops_root_and_early_posts(spark):
    rows = [(1, None, 1, 3600), (2, 1, 1, 100), (3, 1, 1, 7300), (4, 1, 1, 7400), (5, 1, 1, 3700),
            (11, None, 11, 0), (12, 11, 11, 10)]
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in r) for r in rows], SCHEMA)
    got = {r["conversation_id"]: r["peak_hour"] for r in C.observed_time_to_peak(df).collect()}
    assert got == {1.0: 1}


def test_root_replies_and_engagement(spark):
    rows = [("1", 1.0, 7, 1, 1), ("2", 1.0, 3, None, 2), ("5", 5.0, 42, 0, 0), ("9", 8.0, 1, 1, 1), ("4", None, 9, 9, 9)]
    df = spark.createDataFrame(rows, "id_str string, conversationId double, replyCount long, retweetCount long, quoteCount long")
    assert {r["reply_count"] for r in C.root_reply_counts(df).collect()} == {7.0, 42.0}
    got = {r["conversation_id"]: r["engagement"] for r in C.aggregate_engagement(df).collect()}
    assert got == {1.0: 14.0, 5.0: 42.0, 8.0: 3.0}
    with pytest.raises(Exception):
        C.cascade_stats(df.drop("conversationId"))
