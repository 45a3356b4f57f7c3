"""Queries over raw chunks and streams built from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.operators import cascades as C
from tidemark.operators import sampling as S
from tidemark.operators import targeting
from tidemark.operators.joins import lookup, one_to_one
from tidemark.operators.ranks import first_by
from tidemark.plans.registry import query
from tidemark.plans.views import Tables, with_ctes
from tidemark.session import stage, stage_root
from tidemark.sources import posts as R
from tidemark.sources import lists, sinks
from tidemark.streaming import jobs as J
from tidemark.streaming import state as ST


def raw_rows(t: Tables):
    """Orders written as raw post rows: literals as text, some of them broken."""
    c = F.col
    key = c("o_orderkey")
    user = F.when(key % 17 == 3, F.lit("{'id_str': broken")).when(key % 19 == 4, F.lit(None)).otherwise(
        F.concat(
            F.lit("{'id_str': '"), c("o_custkey").cast("string"), F.lit("', 'username': \"O'Brien "), c("o_custkey").cast("string"),
            F.lit("\", 'followersCount': "), (c("o_custkey") * 3).cast("string"), F.lit(", 'friendsCount': None, 'verified': False, 'blue': "),
            F.when(key % 2 == 0, "True").otherwise("None"), F.lit(", 'created': datetime.datetime("), F.date_format("o_orderdate", "yyyy, M, d"),
            F.when(key % 3 == 0, ", 7, 5").otherwise(""), F.lit(", tzinfo=datetime.timezone.utc)}"),
        )
    )
    views = F.when(key % 5 == 0, F.lit("{'count': 'None', 'state': 'Enabled'}")).when(key % 5 == 1, F.lit("{'state': 'Enabled'}")).otherwise(
        F.concat(F.lit("{'count': '"), key.cast("string"), F.lit("', 'state': 'EnabledWithCount'}"))
    )
    links = F.when(key % 4 == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("[{'url': 'https://t.co/x', 'expanded_url': 'https://example.org/"), key.cast("string"), F.lit("'}, {'expanded_url': ''}, {'url': 'only'}]"))
    )
    return t.orders.select(
        key.cast("string").alias("id"), key.cast("string").alias("id_str"),
        (F.lit(1700000000) + key).cast("string").alias("epoch"),
        F.concat(F.lit("He said \"go\",\nthen left "), c("o_orderstatus")).alias("rawContent"),
        F.when(key % 6 == 1, F.lit("n/a")).otherwise((key % 100).cast("string")).alias("replyCount"),
        F.lit("3").alias("retweetCount"), F.lit("").alias("likeCount"), F.lit("1.0").alias("quoteCount"),
        F.concat((key - key % 10).cast("string"), F.lit(".0")).alias("conversationId"),
        F.when(key % 10 != 0, F.concat((key - 1).cast("string"), F.lit(".0"))).alias("in_reply_to_status_id_str"),
        F.when(key % 7 == 0, F.lit("{'id': 5}")).when(key % 7 == 1, F.lit("False")).alias("quotedTweet"),
        F.when(key % 9 == 0, F.lit("FALSE")).alias("retweetedTweet"),
        user.alias("user"), views.alias("viewCount"), links.alias("links"), F.lit("x").alias("media"),
    )


_CLEAN_SPEC = (
    "id_str:s epoch:f replyCount:f likeCount:f is_reply:b is_quote:b is_retweet:b is_original:b user_id_str:s user_username:s"
    " user_followersCount:i user_friendsCount:i user_blue:b user_verified:b created_seconds:i view_count:i n_links:i first_link:s"
)
_CLEAN_SQL = """select k::varchar as id_str, 1700000000 + k as epoch, case when k % 6 = 1 then null else k % 100 end as replyCount, null as likeCount,
    k % 10 <> 0 as is_reply, k % 7 = 0 as is_quote, false as is_retweet, not (k % 10 <> 0 or k % 7 = 0) as is_original,
    case when ok then o_custkey::varchar end as user_id_str, case when ok then 'O''Brien ' || o_custkey end as user_username,
    case when ok then o_custkey * 3 end as user_followersCount, null as user_friendsCount,
    case when ok and k % 2 = 0 then true end as user_blue, case when ok then false end as user_verified,
    case when ok then epoch(date_trunc('day', o_orderdate)) + case when k % 3 = 0 then 25500 else 0 end end as created_seconds,
    case when k % 5 > 1 then k end as view_count, case when k % 4 = 0 then 0 else 1 end as n_links,
    case when k % 4 <> 0 then 'https://example.org/' || k end as first_link
  from (select *, o_orderkey as k, o_orderkey % 17 <> 3 and o_orderkey % 19 <> 4 as ok from orders)"""


def _report(posts):
    return posts.select(
        "*", F.unix_timestamp("user_created_at").alias("created_seconds"), F.size("link_urls").alias("n_links"),
        F.try_element_at("link_urls", F.lit(1)).alias("first_link"),
    )


@query("ingest_parse", _CLEAN_SPEC, _CLEAN_SQL)
def ingest_parse(spark, sf_dir):
    """The parse stage over raw rows."""
    return _report(R.clean(R.spread(raw_rows(Tables(spark, sf_dir)))))


def _chunks(t: Tables) -> str:
    folder = f"{stage_root(t.spark)}/chunks-{uuid.uuid4().hex}"
    raw_rows(t).repartition(4).write.options(
        header=True, quote='"', escape='"', compression="gzip", lineSep="\n", emptyValue="", nullValue=""
    ).csv(folder)
    return folder


@query("ingest_chunks", _CLEAN_SPEC, _CLEAN_SQL)
def ingest_chunks(spark, sf_dir):
    """Gzip CSV chunks with line breaks inside cells, scanned, parsed and cached."""
    folder = _chunks(Tables(spark, sf_dir))
    return _report(R.load_part(spark, folder, cache_path=f"{folder}-cache"))


@query("ingest_stream", _CLEAN_SPEC, _CLEAN_SQL)
def ingest_stream(spark, sf_dir):
    """The same chunks as a stream, one file per trigger."""
    t = Tables(spark, sf_dir)
    folder = _chunks(t)
    raw = J.read_chunks(spark, folder, raw_rows(t).schema)
    J.run_to_end(J.ingest_stream(raw), f"{folder}-out", f"{folder}-state")
    return _report(spark.read.parquet(f"{folder}-out"))


@query(
    "stream_hourly",
    "hour:i event_type:s n:i",
    "select epoch(date_trunc('hour', ts)) as hour, event_type, count(*) as n from events group by 1, 2",
)
def stream_hourly(spark, sf_dir):
    """Tumbling hourly counts per kind from a stream of the events table."""
    t = Tables(spark, sf_dir)
    out = f"{stage_root(spark)}/hourly-{uuid.uuid4().hex}"
    events = J.read_table_files(spark, t.dir, "events.parquet", t.events.schema)
    events = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    J.run_to_end(events, out, f"{out}-state", per_batch=lambda b: J.hourly_counts(b, "ts", "event_type", None))
    return J.added(spark, out, ["hour_start", "event_type"], ["n"]).withColumn("hour", F.unix_timestamp("hour_start"))


@query(
    "stream_cascades",
    "user_id:i n_posts:i engagement:f peak_hour:i",
    """select user_id, sum(c) as n_posts, sum(v) as engagement, arg_max(h, (c, -h)) as peak_hour from (
      select user_id, epoch(date_trunc('hour', ts)) as h, count(*) as c, sum(value) as v from events group by 1, 2) group by 1""",
)
def stream_cascades(spark, sf_dir):
    """Running size, engagement and peak hour per key."""
    t = Tables(spark, sf_dir)
    out = f"{stage_root(spark)}/growth-{uuid.uuid4().hex}"
    events = J.read_table_files(spark, t.dir, "events.parquet", t.events.schema)
    events = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    J.run_to_end(events, out, f"{out}-state", per_batch=lambda b: J.cascade_growth(b, "ts", "user_id", "value", None))
    totals = J.cascade_totals(J.added(spark, out, ["user_id", "hour_start"], ["n", "engagement"]), "user_id")
    return totals.withColumn("peak_hour", F.unix_timestamp("peak_hour"))


@query(
    "stream_keyed_state",
    "user_id:i n_posts:i engagement:f peak_hour:i",
    """select user_id, sum(c) as n_posts, sum(v) as engagement, arg_max(h, (c, -h)) as peak_hour from (
      select user_id, epoch(date_trunc('hour', ts)) as h, count(*) as c, sum(value) as v from events group by 1, 2) group by 1""",
)
def stream_keyed_state(spark, sf_dir):
    """The same totals in keyed state with timers; the events come as files that overlap in time, a few at a trigger."""
    t = Tables(spark, sf_dir)
    base = f"{stage_root(spark)}/keyed-{uuid.uuid4().hex}"
    events = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value", (F.hash("event_id") % 6).alias("part"))
    events.repartition(6, "part").write.parquet(f"{base}-files")
    stream = J.read_table_files(spark, stage_root(spark), base.rsplit("/", 1)[1] + "-files", spark.read.parquet(f"{base}-files").schema, 2)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ST.PROVIDER)
    try:
        J.run_to_end(ST.conversation_totals(stream, "ts", "user_id", "value", "36500 days"), base, f"{base}-state", "update")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    totals = J.latest(spark, base, ["conversation"])
    return totals.withColumnRenamed("conversation", "user_id").withColumn("peak_hour", F.unix_timestamp("peak_hour"))


# ---- joins and set operations --------------------------------------------


@query(
    "one_to_one_join",
    "id:i label:s followers:i replyCount:f",
    with_ctes("seeds activity", "select id, label, followers, replyCount from seeds join activity using (id)"),
)
def one_to_one_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    left = stage(t.view("seeds").select("id", "label", "followers"), "left")
    right = stage(t.view("activity").select("id", "replyCount"), "right")
    return one_to_one(left, right, ["id"])


@query(
    "first_row_per_author",
    "o_custkey:i id:i epoch:f",
    with_ctes("posts", "select o_custkey, arg_min(id, (epoch, id)) as id, min(epoch) as epoch from posts group by o_custkey"),
)
def first_row_per_author(spark, sf_dir):
    posts = Tables(spark, sf_dir).view("posts").select("o_custkey", "id", "epoch")
    return first_by(posts, ["o_custkey"], ["epoch", "id"])


@query(
    "enriched_seeds",
    "id:i label:s c_mktsegment:s",
    with_ctes("seeds", "select id, label, c_mktsegment from seeds left join customer on o_custkey = c_custkey"),
)
def enriched_seeds(spark, sf_dir):
    """Left enrichment on a key reduced to its first row."""
    t = Tables(spark, sf_dir)
    table = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_name")
    return lookup(t.view("seeds").select("id", "label", "o_custkey"), table, "o_custkey", ["c_name"])


@query(
    "noted_and_pool",
    "side:s n:i engagement:f",
    with_ctes("seeds", """select side, count(*) as n, sum(observed_engagement) as engagement from (
      select case when id in (select doc_id from labels) then 'noted' else 'pool' end as side, observed_engagement from seeds) group by side"""),
)
def noted_and_pool(spark, sf_dir):
    """Semi- and anti-join against a key table."""
    t = Tables(spark, sf_dir)
    s = t.view("seeds").select("id", "observed_engagement")
    keys = t.labels.select(F.col("doc_id").alias("id"))
    both = s.join(keys, "id", "left_semi").withColumn("side", F.lit("noted")).unionByName(
        s.join(keys, "id", "left_anti").withColumn("side", F.lit("pool"))
    )
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("observed_engagement").alias("engagement"))


@query(
    "spliced_results",
    "label:s n:i source:s",
    with_ctes("seeds", """select label, count(*) as n, 'old' as source from seeds where label in ('high_credibility', 'mixed') group by label
      union all select label, count(*) as n, 'new' from seeds where label = 'low_credibility' group by label"""),
)
def spliced_results(spark, sf_dir):
    """Old result rows of one key replaced by new ones."""
    s = Tables(spark, sf_dir).view("seeds").where("label is not null")
    counts = s.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    new = counts.where(F.col("label") == K.LOW).withColumn("source", F.lit("new"))
    return sinks.splice(counts.withColumn("source", F.lit("old")), new, "label")


@query(
    "partitioned_sink",
    "label:s n:i",
    with_ctes("seeds", """select label, case when label = 'mixed' then -count(*) else count(*) end as n from seeds where label is not null group by label"""),
)
def partitioned_sink(spark, sf_dir):
    """Write by class, overwrite one class only, read everything back."""
    path = f"{stage_root(spark)}/sink-{uuid.uuid4().hex}"
    s = Tables(spark, sf_dir).view("seeds").where("label is not null")
    counts = s.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    sinks.write_table(counts, path, ["label"])
    sinks.replace_partition(counts.where("label = 'mixed'").withColumn("n", -F.col("n")), path, ["label"])
    return spark.read.parquet(path)


@query("edge_list", "conversation_id:f parent:f child:f", with_ctes("posts", """select distinct p.conversationId as conversation_id, p.in_reply_to_status_id_str as parent, p.id as child
  from posts p join posts q on q.conversationId = p.conversationId and q.id = p.in_reply_to_status_id_str"""))
def edge_list(spark, sf_dir):
    return C.reply_edges(C.reply_rows(Tables(spark, sf_dir).view("posts"))).where("attached")


# ---- lists, unions and text sinks ----------------------------------------


@query(
    "list_scans",
    "source:s entry:s",
    """select distinct 'low' as source, lower(trim(c_mktsegment)) || '.example' as entry from customer
      union all select distinct 'high', 'site' || s_suppkey % 50 || '.example' from supplier where s_suppkey % 5 <> 0
      union all select distinct 'lexicon', lower(p_brand) from part where p_partkey % 2 = 1 and p_partkey % 3 < 2""",
)
def list_scans(spark, sf_dir):
    """The two domain lists and the lexicon, written as the files they come in and scanned: headers, comments, case, flags, repeats."""
    t = Tables(spark, sf_dir)
    base = f"{stage_root(spark)}/lists-{uuid.uuid4().hex}"
    t.customer.select(F.concat(F.lit(" "), F.upper("c_mktsegment"), F.lit(".Example ")).alias("Domain"), F.lit("x").alias("Reason")).write.csv(f"{base}/low", header=True)
    line = F.when(F.col("s_suppkey") % 5 == 0, F.lit("# comment")).otherwise(
        F.concat(F.lit("Site"), (F.col("s_suppkey") % 50).cast("string"), F.lit(".example  # noted")))
    t.supplier.select(line.alias("value")).write.text(f"{base}/high")
    kind = F.when(F.col("p_partkey") % 3 == 0, "anger").when(F.col("p_partkey") % 3 == 1, "disgust").otherwise("joy")
    t.part.select(F.col("p_brand"), kind.alias("e"), (F.col("p_partkey") % 2).cast("string").alias("flag")).write.csv(f"{base}/words", sep="\t")
    parts = {
        "low": lists.low_credibility_domains(spark, f"{base}/low").select(F.col("domain").alias("entry")),
        "high": lists.high_credibility_domains(spark, f"{base}/high").select(F.col("domain").alias("entry")),
        "lexicon": lists.emotion_words(spark, f"{base}/words").select(F.col("word").alias("entry")),
    }
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("source"), "entry")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "multi_part_scan",
    "id_str:s replyCount:f extra:i",
    with_ctes("activity", "select cast(id as varchar) as id_str, replyCount, case when id % 2 = 1 then id % 10 end as extra from activity"),
)
def multi_part_scan(spark, sf_dir):
    """Parts with unlike columns read as one table; a part that is not there is left out."""
    rows = Tables(spark, sf_dir).view("activity").select("id", "id_str", "replyCount")
    base = f"{stage_root(spark)}/parts-{uuid.uuid4().hex}"
    rows.where("id % 2 = 0").drop("id").write.parquet(f"{base}/part_1")
    rows.where("id % 2 = 1").select("id_str", "replyCount", (F.col("id") % 10).alias("extra")).write.parquet(f"{base}/part_2")
    return R.load_parts(spark, R.existing_parts(spark, [f"{base}/part_1", f"{base}/part_2", f"{base}/part_3"]))


@query(
    "text_sinks",
    "format:s label:s n:i",
    with_ctes("seeds", """select format, label, count(*) as n from seeds, (values ('csv'), ('json')) as f(format) where label is not null group by 1, 2"""),
)
def text_sinks(spark, sf_dir):
    """A result table through the CSV and the JSON sink, partitioned, and back."""
    base = f"{stage_root(spark)}/sinks-{uuid.uuid4().hex}"
    s = Tables(spark, sf_dir).view("seeds").where("label is not null")
    counts = stage(s.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "counts")
    out = None
    for fmt in ("csv", "json"):
        sinks.write_table(counts, f"{base}/{fmt}", ["label"], fmt)
        reader = spark.read.schema("n long, label string").option("header", True)
        rows = reader.format(fmt).load(f"{base}/{fmt}").select(F.lit(fmt).alias("format"), "label", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "seed_projection",
    "id_str:s epoch:f user_followersCount:i n_columns:i",
    with_ctes("activity", """select id_str, epoch, user_followersCount, 17 as n_columns from activity where is_original"""),
)
def seed_projection(spark, sf_dir):
    """Original posts, cut to the seed columns the table has."""
    seeds = S.seed_columns(S.originals(Tables(spark, sf_dir).view("activity")))
    return seeds.withColumn("n_columns", F.lit(len(seeds.columns)))


@query(
    "claim_flags",
    "id:i yes:i no:i unclear:i misinfo:i rated:i strict:i",
    """select doc_id as id, (k = 0)::int as yes, (k = 1)::int as no, (k = 2)::int as unclear, (k = 0 or k = 2)::int as misinfo, (k < 3)::int as rated,
      case k when 0 then 1 when 1 then 0 end as strict from (select doc_id, case when quality = 0 then 0 when toxic = 1 then 2 when doc_id % 9 = 0 then 3 when doc_id % 11 = 0 then 4 else 1 end as k from labels)""",
)
def claim_flags(spark, sf_dir):
    """Raters' answers as numbers: both readings of an unclear one, and errors apart."""
    answer = (
        F.when(F.col("quality") == 0, "yes").when(F.col("toxic") == 1, " UNCLEAR").when(F.col("doc_id") % 9 == 0, "ERROR")
        .when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise("No")
    )
    rows = Tables(spark, sf_dir).labels.select(F.col("doc_id").alias("id"), answer.alias("answer"))
    return rows.select("id", *[c.alias(n) for n, c in targeting.claim_flags("answer").items()])
