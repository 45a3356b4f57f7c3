import gzip

import pytest
from pyspark.sql import functions as F

from tidemark.operators import labels as L
from tidemark.sources import lists
from tidemark.sources import posts as P
from tidemark.sources import sinks


def test_literals():
    assert P.literal("{'a': datetime.datetime(2020, 1, 2, 3, 4, 5, tzinfo=datetime.timezone.utc)}") == {"a": "2020-01-02T03:04:05+00:00"}
    assert P.literal("datetime.datetime(2020, 1, 2)") == "2020-01-02T00:00:00+00:00"
    assert P.literal("datetime.datetime(2020, 1, 2, 3, 4, 5, 6)") == "2020-01-02T03:04:05.000006+00:00"
    assert P.literal('{"q": "it\'s, ok"}') == {"q": "it's, ok"}
    for bad in ("{'a': ", "", None, 3, "__import__('os')"):
        assert P.literal(bad) is None


def test_cells():
    assert P._row(None, "{'count': '1234'}", None)["view_count"] == 1234
    for bad in (None, "{'count': None}", "{'count': 'None'}", "{'count': 'abc'}", "{'x': 1}"):
        assert P._row(None, bad, None)["view_count"] is None
    row = P._row("{'id_str': '9', 'followersCount': 3, 'verified': False}", None, "[{'expanded_url': 'u'}, {'expanded_url': ''}, {'url': 'x'}, 4]")
    assert row["user_id_str"] == "9" and row["user_followersCount"] == 3 and row["user_verified"] is False
    assert row["user_blue"] is None and row["link_urls"] == ["u"]


def test_datetime_by_columns(spark):
    texts = ["datetime.datetime(2020, 1, 2, 3, 4, 5, 6, tzinfo=datetime.timezone.utc)", "datetime.datetime(2020, 1, 2)",
             "datetime.datetime(2020, 1, 2, tzinfo=datetime.timezone.utc)", "nothing", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(F.date_format(P.datetime_literal_timestamp(F.col("t")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).collect()]
    assert got == ["2020-01-02T03:04:05.000006", "2020-01-02T00:00:00.000000", "2020-01-02T00:00:00.000000", None, None]


HEADER = "id,id_str,epoch,rawContent,replyCount,conversationId,in_reply_to_status_id_str,user,viewCount,links,quotedTweet,retweetedTweet,media\n"


def _write(folder, name, body):
    with gzip.open(folder / name, "wt", newline="") as f:
        f.write(HEADER + body)


@pytest.fixture
def chunks(tmp_path):
    _write(tmp_path, "b.csv.gz", '3,1801490000000000003,1700000000.5,"says ""hi"",\nbye",x,1.80149E+18,,,,,False,,\n')
    _write(
        tmp_path, "a.csv.gz",
        '1,1801490000000000001,1700000000,plain,5,1.0,,"{\'id_str\': \'7\', \'created\': datetime.datetime(2010, 5, 6)}",'
        '"{\'count\': \'12\'}","[{\'expanded_url\': \'https://a.org/\'}]",,,m\n'
        "2,1801490000000000002,,,,1.0,1.0,broken,,[],{'id': 4},FALSE,\n",
    )
    return tmp_path


def test_load_part(spark, chunks, tmp_path):
    rows = {r["id"]: r for r in P.load_part(spark, str(chunks)).collect()}
    assert set(rows) == {"1", "2", "3"}
    assert rows["3"]["rawContent"] == 'says "hi",\nbye' and rows["3"]["id_str"] == "1801490000000000003"
    assert rows["3"]["replyCount"] is None and rows["3"]["conversationId"] == 1.80149e18
    assert rows["1"]["view_count"] == 12 and rows["1"]["link_urls"] == ["https://a.org/"]
    assert str(rows["1"]["user_created_at"]).startswith("2010-05-06") and rows["1"]["is_original"]
    assert rows["2"]["is_reply"] and rows["2"]["is_quote"] and not rows["2"]["is_retweet"] and rows["2"]["created_at"] is None
    assert rows["2"]["link_urls"] == [] and "media" not in rows["1"].asDict()
    assert rows["3"]["created_at"].microsecond == 500000

    only = P.load_part(spark, str(chunks), max_chunks=1)
    assert {r["id"] for r in only.select("id").collect()} == {"1", "2"}
    cache = str(tmp_path / "cache")
    P.load_part(spark, str(chunks), cache_path=cache)
    assert P.load_part(spark, "/nowhere", cache_path=cache).count() == 3
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception):
        P.load_part(spark, str(tmp_path / "empty"))


def test_parts_with_different_columns(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([(1, "x")], "id int, t string").write.parquet(a)
    spark.createDataFrame([(2,)], "id int").write.parquet(b)
    assert P.existing_parts(spark, [a, "/nowhere", b]) == [a, b]
    assert {(r["id"], r["t"]) for r in P.load_parts(spark, [a, b]).collect()} == {(1, "x"), (2, None)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    for fmt in ("parquet", "csv", "json"):
        sinks.write_table(df, str(tmp_path / fmt), fmt=fmt)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    path = str(tmp_path / "p")
    sinks.write_table(df, path, ["k"])
    sinks.replace_partition(df.where("k = 'b'").selectExpr("k", "v * 10 as v"), path, ["k"])
    assert {(r["k"], r["v"]) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 20)}


def test_lists(spark, tmp_path):
    (tmp_path / "low.csv").write_text("Name,Domain\nx, BadNews.com \ny,\nz,badnews.com\n")
    (tmp_path / "high.txt").write_text("# head\nnytimes.com  # paper\n\nBBC.co.uk\n")
    (tmp_path / "bad.csv").write_text("Name\nx\n")
    (tmp_path / "lex.tsv").write_text("Hate\tanger\t1\nhate\tdisgust\t1\nlove\tjoy\t1\ncalm\tanger\t0\n")
    assert [r[0] for r in lists.low_credibility_domains(spark, str(tmp_path / "low.csv")).collect()] == ["badnews.com"]
    assert {r[0] for r in lists.high_credibility_domains(spark, str(tmp_path / "high.txt")).collect()} == {"nytimes.com", "bbc.co.uk"}
    assert [r[0] for r in lists.emotion_words(spark, str(tmp_path / "lex.tsv")).collect()] == ["hate"]
    with pytest.raises(ValueError):
        lists.low_credibility_domains(spark, str(tmp_path / "bad.csv"))


def test_registered_domains(spark):
    urls = ["https://example.com/path", "https://news.example.com/x", "https://www.bbc.co.uk/news", "HTTPS://EXAMPLE.COM/A",
            "example.com/path", "", "not a url", None, "http://user:pw@m.bbc.co.uk:8080/x?y#z", "https://co.uk/", "https://site.unknownsuffix/",
            "https://example.com./a", "https://192.168.0.1/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "i int, url string").withColumn("host", L.host_of(F.col("url")))
    domains = L.registered_domains(df, lists.public_suffixes(spark))
    got = {r["i"]: r["domain"] for r in df.join(domains, "host", "left").collect()}
    want = ["example.com", "example.com", "bbc.co.uk", "example.com", "example.com", None, None, None, "bbc.co.uk", None, None, "example.com", None]
    assert [got[i] for i in range(len(urls))] == want


def test_url_labels(spark):
    rows = [("1", ["https://badnews.com/x"]), ("2", ["https://www.nytimes.com/x"]), ("3", ["https://badnews.com/x", "https://www.bbc.co.uk/y"]),
            ("4", ["https://random-site.io/x"]), ("5", []), ("6", None), ("7", ["https://m.bbc.co.uk/x"])]
    df = spark.createDataFrame(rows, "id_str string, link_urls array<string>")
    low, high = lists.domain_frame(spark, ["badnews.com", "fakeoutlet.org"]), lists.domain_frame(spark, ["nytimes.com", "bbc.co.uk"])
    out = L.add_url_labels(df, low, high, lists.public_suffixes(spark))
    got = {r["id_str"]: r["credibility_label"] for r in out.collect()}
    assert got == {"1": "low_credibility", "2": "high_credibility", "3": "mixed", "4": None, "5": None, "6": None, "7": "high_credibility"}
    cov = L.label_coverage(out).first()
    assert (cov["total"], cov["mixed"], cov["unlabeled"]) == (7, 1, 3) and cov["labeled_share"] == pytest.approx(4 / 7)


def test_emotion(spark):
    rows = [(1, "Hate hate love"), (2, "calm day"), (3, "hate a b c d"), (4, ""), (5, None), (6, "hate!"), (7, "x hate y z")]
    df = spark.createDataFrame(rows, "id int, t string")
    words = spark.createDataFrame([("hate",)], "word string")
    scores = L.emotion_scores(df, words, "id", "t")
    got = {r["id"]: r["emotion_score"] for r in scores.collect()}
    assert got == pytest.approx({1: 2 / 3, 2: 0, 3: 0.2, 4: 0, 5: 0, 6: 1.0, 7: 0.25})
    assert {r["id"]: r["emotion_score"] for r in L.emotion_scores_inline(df, ["hate"], "id", "t").collect()} == pytest.approx(got)
    labels = {r["id"]: r["emotion_label"] for r in L.emotion_labels(scores).collect()}
    assert labels == {1: None, 2: "low_emotion", 3: None, 4: "low_emotion", 5: "low_emotion", 6: "high_emotion", 7: None}
    with pytest.raises(Exception, match="no lexicon hits"):
        L.emotion_labels(scores.where("emotion_score = 0")).collect()
