import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import propensity as P
from tidemark.operators import textmodel as X
from tidemark.streaming import jobs as J

TEXTS = ["The cat sat, the CAT ran", "A café in Zürich", "cat cafe sat", "", "ab a_b 12 the", "zz"]


def word_terms(t):
    import re

    w = re.findall(r"\b\w\w+\b", t)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def char_terms(t):
    out = []
    for w in t.split():
        p = f" {w} "
        for n in (3, 4, 5):
            if n == 3 or len(p) >= n:
                out += [p[i : i + n] for i in range(max(len(p) - n + 1, 1))]
    return out


def plain(t):
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))


def test_tfidf_against_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")
    counts = X.term_counts(docs, "id", "t")
    got = {(r["id"], r["branch"], r["term"]): r["weight"] for r in X.tfidf(counts, X.document_frequencies(counts), F.lit(len(TEXTS)), "id").collect()}
    want = {}
    for branch, cut in (("word", word_terms), ("char", char_terms)):
        tfs = [Counter(cut(plain(t))) for t in TEXTS]
        df = Counter(term for tf in tfs for term in tf)
        for i, tf in enumerate(tfs):
            raw = {k: (1 + math.log(c)) * (math.log((1 + len(TEXTS)) / (1 + df[k])) + 1) for k, c in tf.items() if df[k] >= 2}
            norm = math.sqrt(sum(v * v for v in raw.values()))
            want |= {(i, branch, k): v / norm for k, v in raw.items()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_out_of_fold_learns_and_covers(spark):
    rows = [(i, ("spam offer now" if i % 2 else "quiet garden walk") + f" w{i % 9}", i % 2) for i in range(60)]
    docs = spark.createDataFrame(rows + [(99, "no label", None)], "id long, t string, y int")
    out = X.out_of_fold(docs, "id", "t", "y", max_iter=15).toPandas()
    assert sorted(out["id"]) == list(range(60)) and set(out["fold"]) == set(range(5))
    assert out[out.y == 1]["p_flagged"].min() > out[out.y == 0]["p_flagged"].max()
    applied = X.refit_and_apply(docs, docs.where("id = 99 or id < 2"), "id", "t", "y", max_iter=15).toPandas()
    assert len(applied) == 3


def test_heads_fit_score_and_persist(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, float(x), float(z), float(x > 0.2), float(z > 0), i % 10 == 0) for i, (x, z) in enumerate(rng.normal(size=(400, 2)))]
    table = spark.createDataFrame(rows, "id long, a double, b double, y_reply double, y_like double, is_val boolean")
    for kind in P.CLASSES:
        models = P.fit_heads(table, ["a", "b"], kind, ["reply", "like"])
        scored = P.score_heads(models, table)
        assert {"p_reply", "p_like", "id", "y_reply"} <= set(scored.columns)
        assert all(r["auc"] > 0.9 for r in P.validation_auc(scored, ["reply", "like"]).collect())
    P.save_heads(models, str(tmp_path / "m"), spark, {"kind": kind})
    again = P.score_heads(P.load_heads(str(tmp_path / "m"), spark), table)
    a, b = (d.orderBy("id").select("p_reply").toPandas()["p_reply"] for d in (scored, again))
    assert np.allclose(a, b)
    with pytest.raises(ValueError):
        P.fit_heads(table, ["a"], "tea_leaves", ["reply"])


def test_stream_equals_batch_over_many_files(spark, tmp_path):
    rows = [(i % 3, f"2024-01-01 {i % 5:02d}:{i % 60:02d}:00", float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, t string, v double").select("k", F.to_timestamp("t").alias("ts"), "v")
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    df.repartition(6).write.parquet(src)
    stream = J.read_table_files(spark, src, "*.parquet", df.schema)
    J.run_to_end(J.cascade_growth(stream, "ts", "k", "v", "30 days"), out, str(tmp_path / "state"), "update")
    got = {tuple(r) for r in J.latest(spark, out, ["k", "hour_start"]).select("k", "hour_start", "n", "engagement").collect()}
    want = {tuple(r) for r in df.groupBy("k", F.date_trunc("hour", "ts")).agg(F.count("*"), F.sum("v")).collect()}
    assert got == want
    totals = {r["k"]: r["n_posts"] for r in J.cascade_totals(J.latest(spark, out, ["k", "hour_start"]), "k").collect()}
    assert sum(totals.values()) == 200


def test_rows_of_one_streamed_file_are_parsed_in_many_tasks(spark, tmp_path):
    from tidemark.sources import posts as R

    cells = {"user": "{'id_str': '1'}", "viewCount": "{'count': '5'}", "links": "[]", "rawContent": "a"}
    columns = ["id", "id_str", "epoch", "in_reply_to_status_id_str", "quotedTweet", "retweetedTweet", *cells]
    raw = spark.range(400).select(*[F.lit(cells[c]).alias(c) if c in cells else F.col("id").cast("string").alias(c) for c in columns])
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    raw.coalesce(1).write.options(header=True, quote='"', escape='"', compression="gzip").csv(src)
    seen = []

    def tasks(batch):
        seen.append(batch.rdd.getNumPartitions())
        return batch

    J.run_to_end(J.ingest_stream(J.read_chunks(spark, src, raw.schema)), out, str(tmp_path / "state"), per_batch=tasks)
    want = {(r["id"], r["view_count"]) for r in R.clean(raw).collect()}
    assert seen == [4] and {(r["id"], r["view_count"]) for r in spark.read.parquet(out).collect()} == want and len(want) == 400


def test_late_rows_are_dropped(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    schema = "ts timestamp, kind string"

    def add(name, t):
        spark.createDataFrame([(t, "a")], "t string, kind string").select(F.to_timestamp("t").alias("ts"), "kind").coalesce(1).write.parquet(str(src / name))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(src / "*"))
        J.run_to_end(J.hourly_counts(stream, "ts", "kind"), out, str(tmp_path / "state"), "update")

    add("one", "2024-01-01 00:10:00")
    run()
    add("two", "2024-01-02 00:10:00")
    run()
    add("three", "2024-01-01 00:20:00")
    run()
    got = {str(r["hour_start"]): r["n"] for r in J.latest(spark, out, ["hour_start", "kind"]).collect()}
    assert got == {"2024-01-01 00:00:00": 1, "2024-01-02 00:00:00": 1}
