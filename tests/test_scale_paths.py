"""Forms that only large tables take, on small ones: levels in log rounds, bounded samples, ranged counts, keyed state."""

import datetime as dt
import random
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibrate as B
from tidemark.operators import cascades as C
from tidemark.operators import compare as M
from tidemark.operators import labels as L
from tidemark.operators import profiles as P
from tidemark.operators import ranks as R
from tidemark.operators import sampling as A
from tidemark.operators import targeting as T
from tidemark.operators import weightgrid as W
from tidemark.session import stage_root
from tidemark.sources import lists
from tidemark.streaming import jobs as J
from tidemark.streaming import state as ST


def breadth_first(links, root):
    below, level, frontier = {}, {root: 0}, [root]
    for parent, child in links:
        below.setdefault(parent, []).append(child)
    while frontier:
        nxt = []
        for node in frontier:
            for child in below.get(node, ()):
                if child not in level:
                    level[child] = level[node] + 1
                    nxt.append(child)
        frontier = nxt
    return level


def links_frame(spark, links, root=0.0):
    return spark.createDataFrame([(1.0, float(p), float(c), root) for p, c in links], "conversation_id double, parent double, child double, root_id double")


def test_levels_of_a_deep_chain_with_two_parent_posts_take_few_rounds(spark, monkeypatch):
    rounds = []
    whole = C.stage
    monkeypatch.setattr(C, "stage", lambda df, name, *a: (rounds.append(name), whole(df, name, *a))[1])
    n = 5000
    links = [(i, i + 1) for i in range(n)]
    links += [(i - 3, i) for i in range(40, n, 97)] + [(50, 20)]  # two parents, and one way back
    got = {r["node"]: r["level"] for r in C.shortest_levels(links_frame(spark, links)).collect()}
    assert got == {float(k): v for k, v in breadth_first(links, 0).items()}
    assert rounds.count("levels") < 20


@pytest.mark.parametrize("most_pairs", [256, 1])
def test_levels_equal_a_breadth_search_on_random_graphs(spark, most_pairs):
    rng = random.Random(5)
    links = {(rng.randrange(60), rng.randrange(1, 90)) for _ in range(150)} | {(i, i + 1) for i in range(100, 130)}
    links |= {(200, 201), (201, 202), (202, 200)}  # a cycle nobody reaches
    got = {r["node"]: r["level"] for r in C.shortest_levels(links_frame(spark, sorted(links)), most_pairs).collect()}
    assert got == {float(k): v for k, v in breadth_first(sorted(links), 0).items()}


@pytest.mark.parametrize("n", [1, 7, 300, 100_000])
def test_bounded_samples_are_the_least_ranked_rows(spark, n):
    rows = [(i, i % 3 if i % 11 else None, "x" * (i % 5)) for i in range(4000)] + [(None, 1, "null id"), (17, 2, "xx"), (17, 2, "xx")]
    df = spark.createDataFrame(rows, "id long, g int, text string").repartition(5)
    want = A.sample_order(df, "id", 9, ["g"]).where(F.col("sample_rank") <= n)
    got = A.least_ranked(df, "id", 9, ["g"], n)
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_a_bounded_sample_moves_few_rows(spark, monkeypatch):
    kept = []
    whole = A.stage

    def count(df, name, *a):
        out = whole(df, name, *a)
        if name == "sample-rows":
            kept.append(out.count())
        return out

    monkeypatch.setattr(A, "stage", count)
    assert A.sample_rows(spark.range(200_000), 500, "id").count() == 500
    assert kept[0] < 800
    assert A.sample_rows(spark.range(0, 200_000, 1, 3), 500, "id").exceptAll(A.sample_rows(spark.range(200_000), 500, "id")).count() == 0


def test_ranges_follow_the_number_of_values(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS_PER_RANGE", 10)
    pdf = pd.DataFrame({"k": [None, "a", "b"] * 700, "x": [float(i * 37 % 501) for i in range(2100)]})
    df = spark.createDataFrame(pdf).withColumn("k", F.when(F.col("k") != "NaN", F.col("k")))
    out = R.ordered_counts(df, "x", ["k"]).toPandas()
    for key, own in out.groupby(out["k"].fillna("null")):
        x = pdf["x"][pdf["k"].fillna("null") == key]
        own = own.sort_values("x")
        assert own["cum_n"].tolist() == [int((x <= v).sum()) for v in own["x"]] and set(own["tot_n"]) == {len(x)}


def events(spark, n=600):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(rng.randrange(9) if rng.random() < 0.97 else None, start + dt.timedelta(minutes=rng.randrange(6000)), rng.choice([None, 0.5, 2.0])) for _ in range(n)]
    return spark.createDataFrame(rows, "conv long, ts timestamp, value double")


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ST.PROVIDER)
    yield
    spark.conf.set(name, before)


def test_keyed_state_over_files_out_of_order_equals_the_batch_table(spark, rocks):
    rows = events(spark)
    base = f"{stage_root(spark)}/keyed-test-{uuid.uuid4().hex}"
    rows.withColumn("part", F.hash("ts") % 4).repartition(4, "part").drop("part").write.parquet(f"{base}/in")
    stream = J.read_table_files(spark, base, "in", rows.schema)
    J.run_to_end(ST.conversation_totals(stream, "ts", "conv", "value", "3650 days"), f"{base}/out", f"{base}/state", "update")
    got = J.latest(spark, f"{base}/out", ["conversation"]).select("conversation", "n_posts", "engagement", "peak_hour", "closed").collect()
    known = rows.where("conv is not null").withColumn("value", F.coalesce("value", F.lit(0.0)))
    want = J.cascade_totals(J.cascade_growth(known, "ts", "conv", "value", None), "conv").collect()
    assert sorted((r[0], r[1], round(r[2], 6), r[3]) for r in got) == sorted((r[0], r[1], round(r[2], 6), r[3]) for r in want)
    assert not any(r["closed"] for r in got)


def test_a_silent_conversation_is_closed_and_begins_anew(spark, rocks):
    base = f"{stage_root(spark)}/keyed-test-{uuid.uuid4().hex}"
    day = lambda d, h=0: dt.datetime(2024, 3, d, h, tzinfo=dt.timezone.utc)
    files = [[(1, day(1), 1.0), (1, day(1, 1), 2.0), (2, day(1), 5.0)], [(2, day(9), 1.0)], [(2, day(20), 1.0)], [(1, day(21), 4.0)]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "conv long, ts timestamp, value double").coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = J.read_table_files(spark, base, "in", spark.read.parquet(f"{base}/in").schema)
        totals = ST.conversation_totals(stream, "ts", "conv", "value", "1 day", idle_hours=72)
        J.run_to_end(totals, f"{base}/out", f"{base}/state", "update")
    got = {(r["conversation"], r["n_posts"], r["engagement"], r["closed"]) for r in spark.read.parquet(f"{base}/out").collect()}
    assert {(1, 2, 3.0, False), (1, 2, 3.0, True), (1, 1, 4.0, False)} <= got


def test_public_suffix_rules(spark):
    lines = ["// a comment", "", "com", "UK", "co.uk  trailing", "*.kawasaki.jp", "!city.kawasaki.jp", "jp"]
    rules = lists.rules_of(spark.createDataFrame([(x,) for x in lines], "value string"))
    want = {
        "a.b.com": "b.com", "b.co.uk": "b.co.uk", "x.b.co.uk": "b.co.uk", "b.uk": "b.uk", "a.b.c.kawasaki.jp": "b.c.kawasaki.jp", "x.city.kawasaki.jp": "city.kawasaki.jp",
        "city.kawasaki.jp": "city.kawasaki.jp", "a.nowhere": "a.nowhere", "q.a.nowhere": "a.nowhere",
    }
    none = ["com", "co.uk", "c.kawasaki.jp", "localhost", "10.0.0.1", "not a host.com", ".com", ""]
    hosts = spark.createDataFrame([(h,) for h in [*want, *none]], "host string")
    got = {r["host"]: r["domain"] for r in L.registered_domains(hosts, rules, unlisted=True).collect()}
    # c.kawasaki.jp is itself a suffix by the wildcard rule.
    assert got == want
    listed = L.registered_domains(hosts, rules)
    assert {r["host"] for r in listed.collect()} == set(want) - {"a.nowhere", "q.a.nowhere"}


def test_deviations_of_large_values_and_null_groups(spark):
    x = [1.7e9 + i for i in (1.0, 2.0, 4.0, 8.0)]
    moments = B.observed_moments(spark.createDataFrame([(v,) for v in x], "reply_count double")).first()
    assert moments["positive_var"] == pytest.approx(np.var(x, ddof=1), rel=1e-9)
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    got = {r["g"]: (r["count"], r["mean"]) for r in P.numeric_profile(rows, ["v"], keys=["g"]).collect()}
    assert got == {None: (2, 2.0), "a": (1, 5.0)}


def test_agreement_inside_tasks_equals_the_shuffled_form(spark, monkeypatch):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(np.round(rng.random((400, 4)), 1), columns=["p_reply", "p_retweet", "p_like", "p_deep"])
    df = spark.createDataFrame(pdf)
    vectors = [*W.named_weights().values(), W.PUBLISHED_2026, dict.fromkeys(("reply", "retweet", "like", "deep"), 0.0)]
    small = {r["v"]: r["rho"] for r in W.rank_agreement(df, vectors).collect()}
    monkeypatch.setattr(W, "fits_one_task", lambda df: False)
    large = {r["v"]: r["rho"] for r in W.rank_agreement(df, vectors).collect()}
    assert small.keys() == large.keys() and all((small[v] is None and large[v] is None) or abs(small[v] - large[v]) < 1e-9 for v in small)


def test_arms_of_several_comparisons(spark):
    rows = [(i, float(i % 7), i % 3 == 0, i % 4 == 1 if i % 5 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v double, a boolean, b boolean")
    case, control = F.col("a"), F.col("b") & ~F.col("a")
    got = {r["comparison"]: r for r in M.compare_arms(df, "id", ["v"], {"one": (case, control), "two": (control, case)}, 200).collect()}
    xs, ys = [r[1] for r in rows if r[2]], [r[1] for r in rows if r[3] and not r[2]]
    one, two = got["one"], got["two"]
    assert (one["n_a"], one["n_b"]) == (len(xs), len(ys)) and one["diff"] == pytest.approx(np.mean(xs) - np.mean(ys))
    assert one["diff"] == pytest.approx(-two["diff"]) and one["ci_lo"] < one["diff"] < one["ci_hi"]
    notes = spark.createDataFrame([(1, True), (1, False), (2, None), (None, True)], "id long, m boolean")
    assert sorted(map(tuple, M.note_flags(notes, "id", {"any_m": F.col("m")}).collect())) == [(1, 2, True), (2, 1, False)]


def test_verdicts(spark):
    rows = [("a", 90, -2.0, -1.0), ("a", 95, -2.0, 1.0), ("b", 90, 1.0, 2.0), ("b", 95, None, None)]
    got = {r["name"]: (r["survives"], r["not_below"]) for r in T.survival(spark.createDataFrame(rows, "name string, quantile int, ci_lo double, ci_hi double")).collect()}
    assert got == {"a": ([90], [95]), "b": ([], [90, 95])}
    flags = spark.createDataFrame([(x,) for x in ("YES", " unclear", "no", "ERROR", None)], "answer string").select(
        *[c.alias(n) for n, c in T.claim_flags("answer").items()])
    assert [tuple(r) for r in flags.collect()] == [(1, 0, 0, 1, 1, 1), (0, 0, 1, 1, 1, None), (0, 1, 0, 0, 1, 0), (0, 0, 0, 0, 0, None), (0, 0, 0, 0, 0, None)]
    diffs = spark.createDataFrame([(0.5,), (-0.5,), (None,)], "d double").select(T.claim_verdict(F.col("d")))
    assert [r[0] for r in diffs.collect()] == ["flagged demoted more", "not demoted more", "indeterminate"]
