"""Queries over posts: profiles, reply trees, labels, calibration, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions import features as X
from tidemark.functions.columns import count_or_zero, safe_ratio
from tidemark.operators import calibrate as B
from tidemark.operators import cascades as C
from tidemark.operators import compare as M
from tidemark.operators import labels as L
from tidemark.operators import profiles as P
from tidemark.operators import sampling as A
from tidemark.plans.panel import PLAN_SHARES_SQL, plan_shares, seeds
from tidemark.plans.registry import query
from tidemark.plans.views import HIGH_DOMAINS, LEXICON, LOW_DOMAINS, Tables, oracle_view, with_ctes
from tidemark.session import stage
from tidemark.sources import lists

# ---- profiles ------------------------------------------------------------


@query(
    "type_shares",
    "n_posts:i share_reply:f share_quote:f share_retweet:f share_original:f",
    with_ctes("activity", """select count(*) as n_posts, avg(case when is_reply then 1e0 else 0e0 end) as share_reply, avg(case when is_quote then 1e0 else 0e0 end) as share_quote,
      avg(case when is_retweet then 1e0 else 0e0 end) as share_retweet, avg(case when is_original then 1e0 else 0e0 end) as share_original from activity"""),
)
def type_shares(spark, sf_dir):
    return P.type_shares(Tables(spark, sf_dir).view("activity"))


_COUNTS = ("replyCount", "retweetCount", "likeCount", "quoteCount")
_PROFILE = "metric:s count:i mean:f p50:f p90:f p95:f p99:f max:f nonzero_share:f"


def _profile_sql(columns, source):
    names = ", ".join(f"'{c}'" for c in columns)
    values = ", ".join(f"cast({c} as double)" for c in columns)
    return f"""select metric, count(*) as count, avg(v) as mean, quantile_cont(v, 0.5) as p50, quantile_cont(v, 0.9) as p90, quantile_cont(v, 0.95) as p95,
      quantile_cont(v, 0.99) as p99, max(v) as max, avg(case when v > 0 then 1e0 else 0e0 end) as nonzero_share,
      min(v) as min, stddev_samp(v) as std, quantile_cont(v, 0.25) as q25, quantile_cont(v, 0.75) as q75
      from (select unnest([{names}]) as metric, unnest([{values}]) as v from {source}) group by metric"""


@query("numeric_profile", _PROFILE, with_ctes("activity", _profile_sql(_COUNTS, "activity")))
def numeric_profile(spark, sf_dir):
    return P.numeric_profile(Tables(spark, sf_dir).view("activity"), _COUNTS)


_USER_COUNTS = ("user_followersCount", "user_friendsCount", "user_statusesCount", "user_favouritesCount")


@query("user_profile", _PROFILE.replace(" nonzero_share:f", ""), with_ctes("activity", _profile_sql(_USER_COUNTS, "activity")))
def user_profile(spark, sf_dir):
    return P.numeric_profile(Tables(spark, sf_dir).view("activity"), _USER_COUNTS)


@query(
    "panel_describe",
    "metric:s count:i mean:f std:f min:f q25:f q50:f q75:f max:f",
    _profile_sql(("l_quantity", "l_extendedprice", "l_discount"), "lineitem").replace("quantile_cont(v, 0.5) as p50", "quantile_cont(v, 0.5) as q50"),
)
def panel_describe(spark, sf_dir):
    return P.describe(Tables(spark, sf_dir).lineitem, ["l_quantity", "l_extendedprice", "l_discount"])


@query(
    "flag_shares",
    "share_user_blue:f share_is_quote:f",
    with_ctes("activity", "select avg(case when user_blue then 1e0 else 0e0 end) as share_user_blue, avg(case when is_quote then 1e0 else 0e0 end) as share_is_quote from activity"),
)
def flag_shares(spark, sf_dir):
    return P.flag_shares(Tables(spark, sf_dir).view("activity"), ["user_blue", "is_quote"])


@query(
    "conversation_sizes",
    "n_conversations:i n_size_ge_2:i n_size_ge_5:i n_size_ge_20:i median_size:f p95_size:f max_size:i",
    with_ctes("posts", """select count(*) as n_conversations, count(*) filter (n >= 2) as n_size_ge_2, count(*) filter (n >= 5) as n_size_ge_5,
      count(*) filter (n >= 20) as n_size_ge_20, quantile_cont(n, 0.5) as median_size, quantile_cont(n, 0.95) as p95_size, max(n) as max_size
      from (select conversationId, count(*)::double as n from posts group by 1)"""),
)
def conversation_sizes(spark, sf_dir):
    return P.conversation_sizes(Tables(spark, sf_dir).view("posts"))


@query(
    "url_coverage",
    "share_with_url:f n_with_url:i mean_urls:f",
    with_ctes("linked", "select avg(case when len(link_urls) > 0 then 1e0 else 0e0 end) as share_with_url, count(*) filter (len(link_urls) > 0) as n_with_url, avg(len(link_urls)) as mean_urls from linked"),
)
def url_coverage(spark, sf_dir):
    return P.url_coverage(Tables(spark, sf_dir).view("linked"))


@query(
    "event_clock",
    "hour:i weight:f",
    """select h as hour, coalesce(n, 0) * (24e0 / sum(n) over ()) as weight from range(24) as r(h)
      left join (select hour(ts) as hh, count(*) as n from events group by 1) on hh = h""",
)
def event_clock(spark, sf_dir):
    e = Tables(spark, sf_dir).events.select(F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("epoch"))
    return P.diurnal_weights(e)


# ---- observed distributions ----------------------------------------------


@query(
    "root_replies",
    "conversation_id:f reply_count:f",
    with_ctes("activity", "select conversationId as conversation_id, replyCount as reply_count from activity where id = conversationId"),
)
def root_replies(spark, sf_dir):
    return C.root_reply_counts(Tables(spark, sf_dir).view("activity"))


@query(
    "aggregate_engagement",
    "conversation_id:f engagement:f",
    with_ctes("activity", "select conversationId as conversation_id, sum(replyCount + retweetCount + quoteCount) as engagement from activity group by 1"),
)
def aggregate_engagement(spark, sf_dir):
    return C.aggregate_engagement(Tables(spark, sf_dir).view("activity"))


@query(
    "observed_ratios",
    "id:i reply_over_spread:f reactive_over_reflective:f reflective_over_reactive:f total_engagement:f log_bin:i",
    with_ctes("activity", """select id, replyCount / (retweetCount + quoteCount + 1e0) as reply_over_spread,
      (retweetCount + likeCount) / (replyCount + quoteCount + 1e0) as reactive_over_reflective,
      (replyCount + quoteCount) / (retweetCount + likeCount + 1e0) as reflective_over_reactive,
      replyCount + retweetCount + likeCount + quoteCount as total_engagement,
      floor(log10(replyCount + retweetCount + likeCount + quoteCount + 1e0)) as log_bin from activity"""),
)
def observed_ratios(spark, sf_dir):
    """Three explicitly named ratios of observed counts, and the engagement bin."""
    reply, repost, like, quote = (count_or_zero(c) for c in _COUNTS)
    total = reply + repost + like + quote
    return Tables(spark, sf_dir).view("activity").select(
        "id",
        C.reply_ratio().alias("reply_over_spread"),
        safe_ratio(repost + like, reply + quote).alias("reactive_over_reflective"),
        safe_ratio(reply + quote, repost + like).alias("reflective_over_reactive"),
        total.alias("total_engagement"),
        F.floor(F.log10(total + F.lit(1.0))).alias("log_bin"),
    )


@query(
    "time_to_peak_observed",
    "conversation_id:f peak_hour:i",
    with_ctes("posts", """select conversationId as conversation_id, arg_max(h, (c, -h)) filter (h >= 0) as peak_hour from (
        select p.conversationId, floor((p.epoch - r.epoch) / 36e2) as h, count(*) as c from posts p join posts r on r.id = p.conversationId
        where p.id <> p.conversationId group by 1, 2) group by 1 having sum(c) >= 2 and sum(c) filter (h >= 0) >= 2"""),
)
def time_to_peak_observed(spark, sf_dir):
    return C.observed_time_to_peak(Tables(spark, sf_dir).view("posts"))


@query(
    "calibration",
    "target_mode:s target_mean:f expected_factor:f baseline_exposures:f n_observed:i n_seeds:i activity:f target_p_zero:f target_positive_mean:f dispersion:f target_positive_var:f",
    with_ctes("activity sums", "").rstrip() + """, obs as (select replyCount as v from activity where id = conversationId),
      f as (select greatest(avg(score_additive / ref * p_reply), 1e-6) as factor, count(*) as n_seeds from sums, (select quantile_cont(score_additive, 0.5) as ref from sums)),
      o as (select count(*) as n, avg(v) as m, avg(case when v = 0 then 1e0 else 0e0 end) as p0, avg(v) filter (v > 0) as pm, var_samp(v) filter (v > 0) as pv,
        quantile_cont(v, 0.95) filter (v > 0) as cut from obs),
      tr as (select avg(v) as tm, var_samp(v) as tv from obs, o where v > 0 and v <= cut)
      select mode as target_mode, m as target_mean, factor as expected_factor, case when mode = 'mean' then m else pm end / factor as baseline_exposures,
        n as n_observed, n_seeds, case when mode <> 'mean' then 1 - p0 end as activity, case when mode <> 'mean' then p0 end as target_p_zero,
        case when mode <> 'mean' then pm end as target_positive_mean,
        case when mode = 'zero_inflated_nb' then case when tv <= tm then 100e0 else least(greatest(tm * tm / (tv - tm), 0.05e0), 100e0) end end as dispersion,
        case when mode = 'zero_inflated_nb' then pv end as target_positive_var
      from f, o, tr, (values ('mean'), ('zero_inflated'), ('zero_inflated_nb')) as t(mode)""",
)
def calibration(spark, sf_dir):
    t = Tables(spark, sf_dir)
    observed = stage(C.root_reply_counts(t.view("activity")), "root-replies")
    return B.calibrate(observed, seeds(t))


_OBS = with_ctes("activity reach posts", "").rstrip() + f""", {PLAN_SHARES_SQL},
  peaks as (select id, arg_max(t_hour, (share, -t_hour)) as peak from shares group by id),
  observed as (
    select 'root_reply_count' as metric, replyCount as v from activity where id = conversationId
    union all select 'aggregate_engagement', sum(replyCount + retweetCount + quoteCount) from activity group by conversationId
    union all select 'reply_ratio', replyCount / (retweetCount + quoteCount + 1e0) from activity
    union all (select 'time_to_peak', arg_max(h, (c, -h)) filter (h >= 0) from (
        select p.conversationId, floor((p.epoch - r.epoch) / 36e2) as h, count(*) as c from activity p join activity r on r.id = p.conversationId
        where p.id <> p.conversationId group by 1, 2) group by conversationId having sum(c) >= 2 and sum(c) filter (h >= 0) >= 2)),
  names as (select distinct regime from reach),
  samples as (
    select regime, metric, true as side, v from observed, names
    union all select regime, 'root_reply_count', false, floor(reach * p_reply) from reach
    union all select regime, 'aggregate_engagement', false, floor(reach * p_reply) + floor(reach * p_retweet) + floor(reach * p_deep) from reach
    union all select regime, 'reply_ratio', false, floor(reach * p_reply) / (floor(reach * p_retweet) + floor(reach * p_deep) + 1e0) from reach
    union all select regime, 'time_to_peak', false, peak from reach join peaks using (id))"""


@query(
    "distribution_records",
    "regime:s metric:s n_a:i n_b:i mean_a:f mean_b:f median_a:f median_b:f p90_a:f p90_b:f ks:f",
    _OBS + """, r as (select regime, metric, side, v, count(*) filter (side) over w as ca, count(*) filter (not side) over w as cb,
        count(*) filter (side) over p as na, count(*) filter (not side) over p as nb from samples
        window w as (partition by regime, metric order by v), p as (partition by regime, metric))
      select regime, metric, max(na) as n_a, max(nb) as n_b, avg(v) filter (side) as mean_a, avg(v) filter (not side) as mean_b,
        quantile_cont(v, 0.5) filter (side) as median_a, quantile_cont(v, 0.5) filter (not side) as median_b,
        quantile_cont(v, 0.9) filter (side) as p90_a, quantile_cont(v, 0.9) filter (not side) as p90_b, max(abs(ca / na - cb / nb)) as ks
      from r group by regime, metric""",
)
def distribution_records(spark, sf_dir):
    """Observed against expected distributions of four metrics under every regime, one keyed job.

    The expected time to peak is the hour of most planned exposure.
    """
    from tidemark.functions.scoring import all_regimes, score_long
    from tidemark.operators.reach import with_reach

    t = Tables(spark, sf_dir)
    posts = stage(t.view("activity"), "activity")
    keep = ["id", "p_reply", "p_retweet", "p_deep"]
    peaks = plan_shares(t).groupBy(F.col("cascade_id").alias("id")).agg(F.max_by("t_hour", F.struct(F.col("share"), -F.col("t_hour"))).alias("peak"))
    reach = stage(with_reach(score_long(seeds(t), all_regimes(), keep)).join(peaks, "id"), "reach")
    reply, repost, quote = (F.floor(F.col("reach") * F.col(f"p_{h}")) for h in ("reply", "retweet", "deep"))
    names = F.explode(F.array(*[F.lit(r.name) for r in all_regimes()])).alias("regime")

    def observed(df, metric, value):
        return df.select(names, F.lit(metric).alias("metric"), F.lit(True).alias("side"), value.cast("double").alias("v"))

    expected = {"root_reply_count": reply, "aggregate_engagement": reply + repost + quote,
                "reply_ratio": safe_ratio(reply, repost + quote), "time_to_peak": F.col("peak")}
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(False).alias("side"), v.cast("double").alias("v")) for m, v in expected.items()])
    parts = [
        observed(C.root_reply_counts(posts), "root_reply_count", F.col("reply_count")),
        observed(C.aggregate_engagement(posts), "aggregate_engagement", F.col("engagement")),
        observed(posts, "reply_ratio", C.reply_ratio()),
        observed(C.observed_time_to_peak(posts), "time_to_peak", F.col("peak_hour")),
    ]
    rows = reach.select("regime", F.inline(cells))
    for part in parts:
        rows = rows.unionByName(part)
    return M.two_sample(stage(rows, "samples"), "v", "side", ["regime", "metric"])


# ---- reply trees ---------------------------------------------------------

_TREE = """with recursive posts as ({posts}),
  sized as (select conversationId as c from posts group by 1 having count(*) >= 2),
  rows_ as (select conversationId as c, id::double as id, in_reply_to_status_id_str as parent, epoch from posts where conversationId in (select c from sized)),
  roots as (select c, arg_min(id, (case when id = c then 0 else 1 end, epoch, id)) as root, arg_min(epoch, (case when id = c then 0 else 1 end, epoch, id)) as root_epoch from rows_ group by c),
  edges as (select distinct r.c, r.parent, r.id from rows_ r join rows_ p on p.c = r.c and p.id = r.parent),
  lev(c, node, level) as (select c, root, 0 from roots union all select l.c, e.id, l.level + 1 from lev l join edges e on e.c = l.c and e.parent = l.node where l.level < 64),
  orphans as (select c, count(*) as n from rows_ r where parent is not null and not exists (select 1 from rows_ p where p.c = r.c and p.id = r.parent) group by c),
  widths as (select c, level, count(*) as w from lev group by c, level),
  hours as (select r.c, floor((epoch - root_epoch) / 36e2) as h, count(*) as n from rows_ r join roots using (c) group by 1, 2),
  peaks as (select c, arg_max(h, (n, -h)) * 3600 as peak from hours group by c),
  stats as (select c as conversation_id, root as root_id, n_posts, coalesce(o.n, 0) as n_orphans, depth, breadth, coalesce(d.n, 0) as direct_replies,
    peak as time_to_peak_seconds, duration_seconds
    from (select c, count(*) as n_posts, max(epoch) - min(epoch) as duration_seconds from rows_ group by c) join roots using (c)
    join (select c, max(level) as depth, max(w) as breadth from widths group by c) using (c) left join orphans o using (c)
    left join (select e.c, count(*) as n from edges e join roots r on r.c = e.c and r.root = e.parent group by 1) d using (c) join peaks using (c))
""".replace("{posts}", oracle_view("posts"))


@query(
    "tree_stats",
    "conversation_id:f root_id:f n_posts:i n_orphans:i depth:i breadth:i direct_replies:i time_to_peak_seconds:f duration_seconds:f",
    _TREE + "select * from stats",
)
def tree_stats(spark, sf_dir):
    return C.cascade_stats(Tables(spark, sf_dir).view("posts"))


@query(
    "tree_quality",
    "n_cascades:i share_depth_ge_2:f share_breadth_ge_2:f mean_size:f median_size:f p95_size:f mean_orphan_share:f",
    _TREE + """select count(*) as n_cascades, avg(case when depth >= 2 then 1e0 else 0e0 end) as share_depth_ge_2, avg(case when breadth >= 2 then 1e0 else 0e0 end) as share_breadth_ge_2,
      avg(n_posts) as mean_size, quantile_cont(n_posts::double, 0.5) as median_size, quantile_cont(n_posts::double, 0.95) as p95_size, avg(n_orphans / n_posts) as mean_orphan_share from stats""",
)
def tree_quality(spark, sf_dir):
    return C.tree_quality(stage(C.cascade_stats(Tables(spark, sf_dir).view("posts")), "tree-stats"))


@query("node_levels", "conversation_id:f node:f level:i", _TREE + "select c as conversation_id, node, level from lev")
def node_levels(spark, sf_dir):
    rows = stage(C.reply_rows(Tables(spark, sf_dir).view("posts"), min_size=2), "rows")
    return C.node_levels(C.reply_edges(rows), stage(C.conversation_roots(rows), "roots"))


@query(
    "orphan_replies",
    "conversation_id:f n_orphans:i",
    _TREE + "select c as conversation_id, n as n_orphans from orphans",
)
def orphan_replies(spark, sf_dir):
    edges = C.reply_edges(C.reply_rows(Tables(spark, sf_dir).view("posts"), min_size=2))
    return edges.where(~F.col("attached")).groupBy("conversation_id").agg(F.sum("n").alias("n_orphans"))


# ---- labels --------------------------------------------------------------

_DOMAIN_SQL = with_ctes("linked", "").rstrip() + f""", urls as (select page_id, unnest(link_urls) as url from linked),
  hosts as (select page_id, rtrim(lower(regexp_extract(trim(url), '^(?:[a-zA-Z][a-zA-Z0-9+.\\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '.') as host from urls),
  domains as (select page_id, case
      when regexp_matches(host, '\\.(co|org)\\.uk$') then regexp_extract(host, '([^.]+\\.(?:co|org)\\.uk)$', 1)
      when regexp_matches(host, '\\.(com|org|net)$') then regexp_extract(host, '([^.]+\\.(?:com|org|net))$', 1) end as domain from hosts),
  sides as (select page_id, bool_or(domain in ({", ".join(repr(d) for d in LOW_DOMAINS)})) as lo, bool_or(domain in ({", ".join(repr(d) for d in HIGH_DOMAINS)})) as hi
    from domains where domain is not null group by page_id),
  labelled as (select l.page_id, case when lo and hi then 'mixed' when lo then 'low_credibility' when hi then 'high_credibility' end as credibility_label
    from linked l left join sides using (page_id))"""


def _labelled(t: Tables):
    low, high = lists.domain_frame(t.spark, LOW_DOMAINS), lists.domain_frame(t.spark, HIGH_DOMAINS)
    return L.add_url_labels(t.view("linked"), low, high, lists.public_suffixes(t.spark), key="page_id")


@query("domain_labels", "page_id:i credibility_label:s", _DOMAIN_SQL + " select * from labelled")
def domain_labels(spark, sf_dir):
    return _labelled(Tables(spark, sf_dir))


@query(
    "label_coverage",
    "total:i low_credibility:i high_credibility:i mixed:i unlabeled:i labeled_share:f",
    _DOMAIN_SQL + """ select count(*) as total, count(*) filter (credibility_label = 'low_credibility') as low_credibility,
      count(*) filter (credibility_label = 'high_credibility') as high_credibility, count(*) filter (credibility_label = 'mixed') as mixed,
      count(*) filter (credibility_label is null) as unlabeled, count(credibility_label) / count(*) as labeled_share from labelled""",
)
def label_coverage(spark, sf_dir):
    return L.label_coverage(_labelled(Tables(spark, sf_dir)))


@query(
    "label_coverage_with_urls",
    "total:i low_credibility:i high_credibility:i mixed:i unlabeled:i labeled_share:f",
    _DOMAIN_SQL + """ select count(*) as total, count(*) filter (credibility_label = 'low_credibility') as low_credibility,
      count(*) filter (credibility_label = 'high_credibility') as high_credibility, count(*) filter (credibility_label = 'mixed') as mixed,
      count(*) filter (credibility_label is null) as unlabeled, count(credibility_label) / count(*) as labeled_share
      from labelled join linked using (page_id) where len(link_urls) > 0""",
)
def label_coverage_with_urls(spark, sf_dir):
    return L.label_coverage(_labelled(Tables(spark, sf_dir)).where(F.size("link_urls") > 0))


@query(
    "registered_domains",
    "domain:s n_links:i",
    _DOMAIN_SQL + " select domain, count(*) as n_links from domains where domain is not null group by domain",
)
def registered_domains(spark, sf_dir):
    t = Tables(spark, sf_dir)
    hosts = t.view("linked").select(F.explode("link_urls").alias("url")).select(L.host_of(F.col("url")).alias("host"))
    counts = hosts.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    domains = L.registered_domains(counts, lists.public_suffixes(spark))
    return counts.join(domains, "host").groupBy("domain").agg(F.sum("n").alias("n_links"))


_RULED = {
    0: ("http://", ".a.example.co.uk/x"), 1: ("https://u@", ".b.c.kawasaki.jp:80"), 2: ("", ".city.kawasaki.jp"), 3: ("//", ".blog.unlisted"),
    4: ("http://", ".kawasaki.jp"), 5: ("http://10.0.0.", "/"), 6: ("ftp://", ".www.ck/y?z=.com"), 7: ("", ".shop.ck"),
}


@query(
    "suffix_rules",
    "host:s domain:s n:i",
    """with made as (select page_id, page_id % 8 as k, 's' || page_id % 13 as s from pages),
      hosts as (select case k when 0 then s || '.a.example.co.uk' when 1 then s || '.b.c.kawasaki.jp' when 2 then s || '.city.kawasaki.jp' when 3 then s || '.blog.unlisted'
        when 4 then s || '.kawasaki.jp' when 5 then '10.0.0.' || page_id % 13 when 6 then s || '.www.ck' else s || '.shop.ck' end as host,
      case k when 0 then 'example.co.uk' when 1 then 'b.c.kawasaki.jp' when 2 then 'city.kawasaki.jp' when 3 then 'blog.unlisted'
        when 6 then 'www.ck' when 7 then s || '.shop.ck' end as domain from made)
      select host, domain, count(*) as n from hosts group by all""",
)
def suffix_rules(spark, sf_dir):
    """Hosts under two-part, wildcard, exception and unlisted suffixes, an address and a bare suffix, made of the pages' ids."""
    k = F.col("page_id") % 8
    name = F.when(k == 5, (F.col("page_id") % 13).cast("string")).otherwise(F.concat(F.lit("s"), (F.col("page_id") % 13).cast("string")))
    before = F.element_at(F.array(*[F.lit(_RULED[i][0]) for i in range(8)]), (k + 1).cast("int"))
    after = F.element_at(F.array(*[F.lit(_RULED[i][1]) for i in range(8)]), (k + 1).cast("int"))
    hosts = Tables(spark, sf_dir).pages.select(L.host_of(F.concat(before, name, after)).alias("host"))
    counts = hosts.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(L.registered_domains(counts, lists.public_suffixes(spark), unlisted=True), "host", "left")


@query(
    "list_overlap",
    "domain:s n_links:i",
    _DOMAIN_SQL + f""" select domain, count(*) as n_links from domains where domain in ({", ".join(repr(d) for d in LOW_DOMAINS)})
      and domain in ({", ".join(repr(d) for d in HIGH_DOMAINS)}) group by domain""",
)
def list_overlap(spark, sf_dir):
    """Domains on both lists, with the links they affect."""
    t = Tables(spark, sf_dir)
    both = lists.list_overlap(lists.domain_frame(spark, LOW_DOMAINS), lists.domain_frame(spark, HIGH_DOMAINS))
    return registered_domains(spark, sf_dir).join(both, "domain")


_EMOTION = """with toks as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+') as t from documents),
  scored as (select doc_id, case when len(t) = 0 then 0e0 else len(list_filter(t, lambda w: list_contains([{lex}], w))) / len(t) end as emotion_score from toks),
  single as (select doc_id, emotion_score::float::double as s from scored),
  cut as (select quantile_cont(s, 0.8) as q from single where s > 0),
  labelled as (select doc_id, s as emotion_score, case when s >= q then 'high_emotion' when s = 0 then 'low_emotion' end as emotion_label from single, cut)
""".replace("{lex}", ", ".join("'" + w.replace("'", "''") + "'" for w in LEXICON))


def _words(spark):
    return spark.createDataFrame([(w,) for w in LEXICON], "word string")


@query("emotion_scores", "doc_id:i emotion_score:f", _EMOTION + "select * from scored")
def emotion_scores(spark, sf_dir):
    return L.emotion_scores(Tables(spark, sf_dir).documents, _words(spark), "doc_id", "text")


@query("emotion_scores_inline", "doc_id:i emotion_score:f", _EMOTION + "select * from scored")
def emotion_scores_inline(spark, sf_dir):
    return L.emotion_scores_inline(Tables(spark, sf_dir).documents, LEXICON, "doc_id", "text")


def _emotions(t: Tables):
    scores = stage(L.emotion_scores(t.documents, _words(t.spark), "doc_id", "text"), "emotion")
    return L.emotion_labels(scores)


@query("emotion_labels", "doc_id:i emotion_label:s", _EMOTION + "select * from labelled")
def emotion_labels(spark, sf_dir):
    return _emotions(Tables(spark, sf_dir))


@query(
    "emotion_coverage",
    "total:i high_emotion:i low_emotion:i unlabeled_middle:i labeled_share:f",
    _EMOTION + """select count(*) as total, count(*) filter (emotion_label = 'high_emotion') as high_emotion, count(*) filter (emotion_label = 'low_emotion') as low_emotion,
      count(*) filter (emotion_label is null) as unlabeled_middle, count(emotion_label) / count(*) as labeled_share from labelled""",
)
def emotion_coverage(spark, sf_dir):
    return L.emotion_coverage(_emotions(Tables(spark, sf_dir)))


@query(
    "text_fields",
    "doc_id:i text_length:i head_length:i flat_length:i",
    """select doc_id, length(coalesce(text, '')) as text_length, length(substr(text, 1, 1000)) as head_length,
      length(substr(replace(text, chr(10), ' '), 1, 200)) as flat_length from documents""",
)
def text_fields(spark, sf_dir):
    """Full length, and the two display cuts the reports use."""
    return Tables(spark, sf_dir).documents.select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("text_length"),
        F.length(F.substring("text", 1, 1000)).alias("head_length"),
        F.length(F.substring(F.regexp_replace("text", "\n", " "), 1, 200)).alias("flat_length"),
    )


# ---- features ------------------------------------------------------------

_FEATURES = with_ctes("activity", "").rstrip() + """, dated as (select *, extract(epoch from o.o_orderdate) as created from activity a join orders o on o.o_orderkey = a.id),
  aged as (select *, greatest(epoch - case when created > 0 then created else 0 end, 0e0) / 864e2 as age from dated),
  features as (select id, ln(1e0 + user_followersCount) as log_followers, ln(1e0 + user_friendsCount) as log_friends, ln(1e0 + user_statusesCount) as log_statuses,
    ln(1e0 + user_favouritesCount) as log_favourites, ln(1e0 + user_listedCount) as log_listed, ln((user_followersCount + 1e0) / (user_friendsCount + 1e0)) as log_clout,
    ln(1e0 + user_favouritesCount / greatest(user_statusesCount, 1e0)) as log_favs_per_status, ln(1e0 + user_statusesCount / greatest(age, 1e0)) as log_statuses_per_day,
    ln(1e0 + age) as log_account_age_days, ln(1e0 + length(rawContent)) as log_text_length,
    sin(2e0 * pi() * (epoch / 36e2 % 24e0) / 24e0) as hour_sin, cos(2e0 * pi() * (epoch / 36e2 % 24e0) / 24e0) as hour_cos,
    sin(2e0 * pi() * (epoch / 36e2 % 168e0) / 168e0) as weekhour_sin, cos(2e0 * pi() * (epoch / 36e2 % 168e0) / 168e0) as weekhour_cos,
    case when user_blue then 1e0 else 0e0 end as user_blue, case when is_reply then 1e0 else 0e0 end as is_reply, case when is_quote then 1e0 else 0e0 end as is_quote,
    case when id % 3 = 0 then 1e0 else 0e0 end as has_url from aged)"""
_FEATURE_SPEC = " ".join(f"{f}:f" for f in K.FEATURES)


def feature_posts(t: Tables):
    """Posts with a creation date (the order date) and a link on every third."""
    dates = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("user_created_at"))
    link = F.when(F.col("id") % 3 == 0, F.array(F.lit("https://example.org/"))).otherwise(F.array().cast("array<string>"))
    return t.view("activity").join(dates, "id").withColumn("link_urls", link)


@query("features", f"id:i {_FEATURE_SPEC}", _FEATURES + " select * from features")
def features(spark, sf_dir):
    return X.extract_features(feature_posts(Tables(spark, sf_dir)), ["id"])


@query(
    "features_without_account_date",
    "id:i log_account_age_days:f log_statuses_per_day:f",
    with_ctes("activity", "select id, ln(1e0 + epoch / 864e2) as log_account_age_days, ln(1e0 + user_statusesCount / greatest(epoch / 864e2, 1e0)) as log_statuses_per_day from activity"),
)
def features_without_account_date(spark, sf_dir):
    """The values rows get when the creation date was lost on the way."""
    return X.extract_features(feature_posts(Tables(spark, sf_dir)), ["id"], legacy_missing_created=True)


@query(
    "targets",
    "id:i y_reply:f y_retweet:f y_like:f y_deep:f",
    with_ctes("activity", """select id, case when replyCount > 0 then 1e0 else 0e0 end as y_reply, case when retweetCount > 0 then 1e0 else 0e0 end as y_retweet,
      case when likeCount > 0 then 1e0 else 0e0 end as y_like, case when quoteCount > 0 then 1e0 else 0e0 end as y_deep from activity"""),
)
def targets(spark, sf_dir):
    return Tables(spark, sf_dir).view("activity").select("id", *[c.alias(n) for n, c in X.target_columns().items()])


@query(
    "scaled_features",
    f"id:i {_FEATURE_SPEC}",
    _FEATURES + " select id, " + ", ".join(
        f"({f} - avg({f}) over ()) / greatest(stddev_pop({f}) over (), 1e-6) as {f}" if f in K.CONTINUOUS_FEATURES else f for f in K.FEATURES
    ) + " from features",
)
def scaled_features(spark, sf_dir):
    rows = stage(X.extract_features(feature_posts(Tables(spark, sf_dir)), ["id"]), "features")
    return X.apply_scaler(rows, X.scaler_stats(rows))


@query(
    "account_age",
    "id:i account_age_days:f",
    "select o_orderkey as id, (epoch(timestamp '2024-06-15') - epoch(o_orderdate)) / 864e2 as account_age_days from orders",
)
def account_age(spark, sf_dir):
    reference = F.unix_timestamp(F.lit(f"{K.AGE_REFERENCE_DATE} 00:00:00").cast("timestamp"))
    created = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return Tables(spark, sf_dir).orders.select(
        F.col("o_orderkey").alias("id"), ((reference - created) / F.lit(86400.0)).alias("account_age_days")
    )


# ---- bins ----------------------------------------------------------------

_EDGES = with_ctes("seeds", "").rstrip() + """, e as (select quantile_cont(v, 0) as e0, quantile_cont(v, 0.2) as e1, quantile_cont(v, 0.4) as e2, quantile_cont(v, 0.6) as e3,
    quantile_cont(v, 0.8) as e4, quantile_cont(v, 1) as e5, quantile_cont(v, 1e0/3e0) as t1, quantile_cont(v, 2e0/3e0) as t2 from (select followers::double as v from seeds))"""


@query(
    "bins_four_modes",
    "id:i left_bin:i level_stratum:i tertile:s",
    _EDGES + """ select id, case when followers >= e4 then 4 when followers >= e3 then 3 when followers >= e2 then 2 when followers >= e1 then 1 else 0 end as left_bin,
      case when followers <= e1 then 1 when followers <= e2 then 2 when followers <= e3 then 3 when followers <= e4 then 4 else 5 end as level_stratum,
      case when followers <= t1 then 'low' when followers <= t2 then 'mid' else 'high' end as tertile from seeds, e""",
)
def bins_four_modes(spark, sf_dir):
    s = seeds(Tables(spark, sf_dir)).select("id", F.col("followers").cast("double").alias("followers"))
    s = A.quantile_bins(s, "followers", name="left_bin")
    s = A.level_strata(s, "followers", name="level_stratum")
    return A.tertile(s, "followers")


@query(
    "follower_strata",
    "id:i stratum:i",
    _EDGES + " select id, case when followers <= e1 then 0 when followers <= e2 then 1 when followers <= e3 then 2 when followers <= e4 then 3 else 4 end as stratum from seeds, e",
)
def follower_strata(spark, sf_dir):
    return A.follower_strata(seeds(Tables(spark, sf_dir)).select("id", "followers"), "followers", "id")
