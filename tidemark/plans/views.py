"""Views that read the given tables as posts, engagement, seeds and panels.

Each view is one SQL text understood by Spark and by the oracle engine; the only
dialect word is ``LIST(...)``. Views are projections, one grouped aggregate and
key joins, so they scale with the tables they read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from tidemark import constants as K

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Orders read as posts in blocks of 16: stars, chains, heaps, heaps without an
# in-table root, and single posts. Every 11th post answers a post that is absent.
_POSTS = """
select id, cast(id as string) as id_str,
  cast(case when shape = 4 then id when shape = 3 then -block - 1 else block * 16 end as double) as conversationId,
  cast(case when shape = 4 or off = 0 then null
            when id % 11 = 0 then -id
            when shape = 0 then block * 16
            when shape = 1 then id - 1
            else block * 16 + cast(floor((off - 1) / 2) as bigint) end as double) as in_reply_to_status_id_str,
  cast(1700000000 + block * 1000 + cast(floor(o_totalprice) as bigint) % 36000 as double) as epoch,
  o_custkey, o_orderstatus, o_orderpriority, o_totalprice
from (
  select *, case when block % 8 = 5 then 4 else block % 4 end as shape
  from (
    select o_orderkey as id, cast(floor(o_orderkey / 16) as bigint) as block, o_orderkey % 16 as off,
      o_custkey, o_orderstatus, o_orderpriority, o_totalprice
    from {orders}
  ) as keyed
) as shaped
"""

_ENGAGEMENT = """
select l_orderkey as id,
  sum(case when l_returnflag = 'R' then 1 else 0 end) as replies,
  sum(cast(l_linenumber as bigint)) as retweets,
  sum(cast(l_quantity as bigint)) as likes,
  sum(case when l_discount > 5e-2 then 1 else 0 end) as quotes
from {lineitem} group by l_orderkey
"""

_ACTIVITY = """
select p.*,
  cast(coalesce(e.replies, 0) as double) as replyCount,
  cast(coalesce(e.retweets, 0) as double) as retweetCount,
  cast(coalesce(e.likes, 0) as double) as likeCount,
  cast(coalesce(e.quotes, 0) as double) as quoteCount,
  p.in_reply_to_status_id_str is not null as is_reply,
  p.id % 7 = 3 as is_quote,
  p.id % 13 = 5 as is_retweet,
  not (p.in_reply_to_status_id_str is not null or p.id % 7 = 3 or p.id % 13 = 5) as is_original,
  concat(p.o_orderpriority, ' ', p.o_orderstatus, ' ', cast(p.o_custkey as string)) as rawContent,
  cast(p.o_custkey as string) as user_id_str,
  cast(floor(p.o_totalprice / 10) as bigint) as user_followersCount,
  p.o_custkey % 997 as user_friendsCount,
  p.o_custkey * 3 % 5003 as user_statusesCount,
  p.o_custkey * 7 % 4001 as user_favouritesCount,
  p.o_custkey % 53 as user_listedCount,
  case when p.o_custkey % 10 = 9 then null else p.o_custkey % 4 = 0 end as user_blue
from ({posts}) as p left join ({engagement}) as e on p.id = e.id
"""

# Sums of whole numbers divided once: the same bits in every engine and plan.
_SEEDS = """
select o.id, o.id as cascade_id, o.o_custkey,
  l.disc / (1e2 * l.n) as p_reply,
  l.qty / (5e1 * l.n) as p_retweet,
  l.price / (1e3 * l.n) as p_like,
  l.tax * 5e0 / (1e2 * l.n) as p_deep,
  case when o.o_custkey % 30 = 2 then 'mixed'
       when o.o_custkey % 3 = 0 then 'low_credibility'
       when o.o_custkey % 3 = 1 then 'high_credibility' end as label,
  (cast(floor(o.o_totalprice * 100) as bigint) % 997) / 997e0 as p_cred,
  o.o_orderstatus = 'F' as flagged,
  o.epoch,
  cast(floor(o.o_totalprice / 10) as bigint) as followers,
  l.n as n_lines, l.qty as observed_engagement
from ({posts}) as o join (
  select l_orderkey, count(*) as n,
    sum(cast(round(l_discount * 100) as bigint)) as disc,
    sum(cast(round(l_tax * 100) as bigint)) as tax,
    sum(cast(l_quantity as bigint)) as qty,
    sum(cast(floor(l_extendedprice) as bigint) % 1000) as price
  from {lineitem} group by l_orderkey
) as l on o.id = l.l_orderkey
"""

# Pages read as posts with one link, two links or none.
_LINKED = """
select page_id, cast(page_id as string) as id_str,
  case when page_id % 5 = 0 then LIST()
       when page_id % 3 = 0 then LIST(url, concat('https://m.wire.co.uk/', cast(page_id as string)))
       when page_id % 7 = 0 then LIST(url, 'HTTP://News.Example.ORG:8080/a?b=c', 'not a url')
       else LIST(url) end as link_urls
from {pages}
"""

_TEXTS = {
    "posts": _POSTS,
    "engagement": _ENGAGEMENT,
    "activity": _ACTIVITY,
    "seeds": _SEEDS,
    "linked": _LINKED,
}
_NEEDS = {"activity": ("posts", "engagement"), "seeds": ("posts",)}

LOW_DOMAINS = ("example.org", "wire.co.uk")
HIGH_DOMAINS = ("example.com", "example.org.uk", "wire.co.uk")
LEXICON = (
    "the", "que", "and", "der", "los", "that", "leux", "tion", "con", "und", "they're", "est",
    "which", "nicht", "pour", "ing",
)


class Tables:
    """The given tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        """A view over the tables it names; unused columns are pruned at the scan."""
        return self.spark.sql(*self._text(name))

    def _text(self, name: str):
        spark_text = _expand(name).replace("LIST(", "array(")
        for table in TABLES:
            if f"{{{table}}}" in spark_text:
                spark_text = spark_text.replace(f"{{{table}}}", f"parquet.`{self.dir}/{table}.parquet`")
        return (spark_text,)


def _expand(name: str) -> str:
    text = _TEXTS[name]
    for inner in _NEEDS.get(name, ()):
        text = text.replace(f"({{{inner}}})", f"({_expand(inner)})")
    return text


def oracle_view(name: str) -> str:
    """The same view for the oracle engine, where tables are registered by name."""
    text = _expand(name).replace("LIST(", "list_value(")
    for table in TABLES:
        text = text.replace(f"{{{table}}}", table)
    return text


# ---- oracle building blocks ----------------------------------------------

_FORMS = {
    "additive": "13.5e0 * p_reply + 1e0 * p_retweet + 0.5e0 * p_like + 2e0 * p_deep",
    "additive_retuned": "6.75e0 * p_reply + 1e0 * p_retweet + 0.5e0 * p_like + 2e0 * p_deep",
    "ablated": "s_slow * (1e0 + 1e0 * s_fast)",
    "ratio_correction": "score_additive / (1e0 + 1e0 * (s_fast / (s_slow + 1e-6)))",
    "reflective_floor": "score_additive * (1e0 / (1e0 + exp(-((s_slow - 1e0) / 0.5e0))))",
    "fast_floor": "score_additive * (1e0 / (1e0 + exp(-((s_fast - 1e0) / 0.5e0))))",
    "complementary": "pow(greatest(s_slow, 1e-9), 0.75e0) * pow(greatest(s_fast, 1e-9), 0.25e0)",
    "complementary_even": "pow(greatest(s_slow, 1e-9), 0.5e0) * pow(greatest(s_fast, 1e-9), 0.5e0)",
}

CTES = {
    "posts": oracle_view("posts"),
    "activity": oracle_view("activity"),
    "seeds": oracle_view("seeds"),
    "linked": oracle_view("linked"),
    "sums": f"""select *, {_FORMS['additive']} as score_additive,
        13.5e0 * p_reply + 2e0 * p_deep as s_slow, 1e0 * p_retweet + 0.5e0 * p_like as s_fast from seeds""",
    "wide": "select *, " + ", ".join(
        f"{text} as score_{name}" for name, text in _FORMS.items() if name != "additive"
    ) + """,
        case when s_slow + s_fast <> 0 then s_fast / (s_slow + s_fast) end as fast_share,
        1e0 / (1e0 + exp(-((s_slow - 1e0) / 0.5e0))) as gate from sums""",
    "long": " union all ".join(
        f"select id, label, '{name}' as regime, score_{name} as score, p_reply, p_retweet, p_like, p_deep from wide"
        for name in _FORMS
    ),
    "reach": """select l.*, score / ref as rel_score, least(greatest(200e0 * (score / ref), 0e0), 50000e0) as reach
        from long l join (select regime, quantile_cont(score, 0.5) as ref from long group by regime) r using (regime)""",
    "gaps": """select regime, avg(reach) filter (label = 'low_credibility') as low_mean,
        avg(reach) filter (label = 'high_credibility') as high_mean,
        avg(reach) filter (label = 'low_credibility') - avg(reach) filter (label = 'high_credibility') as gap
        from reach group by regime""",
    "panel": """select regime, replicate, id as cascade_id, label, reach as total_exposures,
        floor(reach * p_reply * (1e0 + ((id * 7 + replicate * 13) % 11 - 5) / 5e1)) as n_reply,
        floor(reach * p_retweet * (1e0 + ((id * 5 + replicate * 17) % 11 - 5) / 5e1)) as n_retweet,
        floor(reach * p_like * (1e0 + ((id * 3 + replicate * 19) % 11 - 5) / 5e1)) as n_like,
        floor(reach * p_deep * (1e0 + ((id * 11 + replicate * 23) % 11 - 5) / 5e1)) as n_deep
        from reach, range(5) as t(replicate)
        where regime in ('additive', 'additive_retuned', 'ablated', 'reflective_floor')""",
}
_CTE_NEEDS = {
    "sums": ("seeds",), "wide": ("sums",), "long": ("wide",), "reach": ("long",),
    "gaps": ("reach",), "panel": ("reach",),
}

PANEL_REGIMES = ("additive", "additive_retuned", "ablated", "reflective_floor")
N_REPLICATES = 5


def with_ctes(names: str, body: str) -> str:
    """``body`` behind the named building blocks and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for inner in _CTE_NEEDS.get(name, ()):
            add(inner)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    heads = ", ".join(f"{n} as materialized ({CTES[n]})" for n in order)
    return f"with {heads} {body}"


def percent_rank_sql(value: str, partition: str = "") -> str:
    """Average rank scaled to [0, 100], as a window expression."""
    p = f"partition by {partition}" if partition else ""
    return (
        f"100e0 * ((rank() over ({p} order by {value}) + (count(*) over ({p + ' ,' if p else 'partition by'} {value}) - 1) / 2e0) - 1e0)"
        f" / (count(*) over ({p}) - 1)"
    )


def average_rank_sql(value: str, partition: str = "") -> str:
    p = f"partition by {partition}" if partition else ""
    return f"(rank() over ({p} order by {value}) + (count(*) over ({p + ' ,' if p else 'partition by'} {value}) - 1) / 2e0)"


#: Draws of every bootstrap query.
N_BOOT = 1000
_STEPS = [math.fsum(math.exp(-1.0) / math.factorial(j) for j in range(k + 1)) for k in range(13)]


def poisson_draws_sql(src: str, n: int = N_BOOT) -> str:
    """Rows of ``src`` times n replicates with their Poisson weight ``w``: integer arithmetic on cascade_id and replicate."""
    cases = " ".join(f"when u < {x!r} then {k}" for k, x in enumerate(_STEPS))
    return f"""select * exclude (a, b, u), case {cases} else 13 end as w from (
      select * exclude h, xor(h, h >> 16) / 2147483647e0 as u from (
      select * exclude h, (xor(h, h >> 13) * 1103515245 + 12345) % 2147483647 as h from (
      select * exclude h, (xor(h, h >> 15) * 69621 + b) % 2147483647 as h from (
      select *, (a * 48271 + b) % 2147483647 as h from (
      select *, (cascade_id % 2147483647) as a, (replicate * 1103515245 + {K.SEED}) % 2147483647 as b from {src}, range({n}) as r(replicate))))))"""


LOW, HIGH = K.LOW, K.HIGH
