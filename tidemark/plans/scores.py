"""Queries over seed scores: regimes, gates, exposure, sweeps and weight search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions import scoring as S
from tidemark.functions.features import feature_columns, substance_stats, with_substance
from tidemark.operators import contrasts as C
from tidemark.operators import profiles as P
from tidemark.operators import reach as R
from tidemark.operators import targeting as T
from tidemark.operators import weightgrid as W
from tidemark.plans.panel import mechanism_seeds, regimes, seeds
from tidemark.plans.registry import query
from tidemark.plans.views import N_BOOT, Tables, poisson_draws_sql, with_ctes
from tidemark.session import stage

_NAMES = [r.name for r in S.all_regimes()]
_SCORE_COLS = " ".join(f"score_{n}:f" for n in _NAMES)


@query(
    "flagship_gap_contrast",
    "regime:s low_mean:f high_mean:f gap:f contrast:f",
    with_ctes("gaps", "select g.*, g.gap - b.gap as contrast from gaps g, gaps b where b.regime = 'additive'"),
)
def flagship_gap_contrast(spark, sf_dir):
    """Does a regime narrow or widen the reach gap between the two classes?"""
    t = Tables(spark, sf_dir)
    return R.gap_contrasts(R.with_reach(S.score_long(seeds(t), S.all_regimes(), ["label"])))


@query(
    "regime_scores_all",
    f"id:i {_SCORE_COLS}",
    with_ctes("wide", "select * from wide"),
)
def regime_scores_all(spark, sf_dir):
    return S.with_scores(Tables(spark, sf_dir).view("seeds"), S.all_regimes())


@query(
    "mechanism_profile",
    "id:i s_slow:f s_fast:f fast_share:f gate:f mult_ablated:f mult_floor:f",
    with_ctes(
        "wide",
        "select *, score_ablated / (score_additive + 1e-12) as mult_ablated,"
        " score_reflective_floor / (score_additive + 1e-12) as mult_floor from wide",
    ),
)
def mechanism_profile(spark, sf_dir):
    return S.mechanism(Tables(spark, sf_dir).view("seeds"))


@query(
    "score_ratios",
    "id:i pred_ratio:f pred_ratio_smooth:f reflective_smooth:f slow_mass:f fast_mass:f",
    with_ctes(
        "seeds",
        """select id, case when p_reply + p_deep <> 0 then (p_retweet + p_like) / (p_reply + p_deep) end as pred_ratio,
        (p_retweet + p_like) / (p_reply + p_deep + 1e-3) as pred_ratio_smooth,
        (p_reply + p_deep) / (p_retweet + p_like + 1e-3) as reflective_smooth,
        p_reply + p_deep as slow_mass, p_retweet + p_like as fast_mass from seeds""",
    ),
)
def score_ratios(spark, sf_dir):
    """Predicted ratios with and without the smoothing term, and unweighted masses."""
    slow, fast = F.col("p_reply") + F.col("p_deep"), F.col("p_retweet") + F.col("p_like")
    return Tables(spark, sf_dir).view("seeds").select(
        "id",
        F.try_divide(fast, slow).alias("pred_ratio"),
        S.reactive_ratio(1e-3).alias("pred_ratio_smooth"),
        S.reflective_ratio(1e-3).alias("reflective_smooth"),
        slow.alias("slow_mass"),
        fast.alias("fast_mass"),
    )


_VARIANTS = {
    "default": ("13.5e0 * p_reply + 2e0 * p_deep", "1e0 * p_retweet + 0.5e0 * p_like"),
    "quote_as_fast": ("13.5e0 * p_reply", "1e0 * p_retweet + 0.5e0 * p_like + 2e0 * p_deep"),
    "like_as_slow": ("13.5e0 * p_reply + 0.5e0 * p_like + 2e0 * p_deep", "1e0 * p_retweet"),
    "reply_only_slow": ("13.5e0 * p_reply", "1e0 * p_retweet + 0.5e0 * p_like"),
}


@query(
    "partition_sweep",
    "regime:s gap:f contrast:f",
    with_ctes(
        "sums",
        "select g.regime, g.gap, g.gap - b.gap as contrast from (select regime,"
        " avg(r) filter (label = 'low_credibility') - avg(r) filter (label = 'high_credibility') as gap from ("
        "select regime, label, least(greatest(200e0 * (score / quantile_cont(score, 0.5) over (partition by regime)), 0e0), 50000e0) as r from ("
        "select label, 'additive' as regime, score_additive as score from sums union all "
        + " union all ".join(
            f"select label, 'ablated:{n}', ({slow}) * (1e0 + 1e0 * ({fast})) from sums"
            for n, (slow, fast) in _VARIANTS.items()
        )
        + ")) group by regime) g, (select avg(r) filter (label = 'low_credibility') - avg(r) filter (label = 'high_credibility') as gap from"
        " (select label, least(greatest(200e0 * (score_additive / quantile_cont(score_additive, 0.5) over ()), 0e0), 50000e0) as r from sums)) b",
    ),
)
def partition_sweep(spark, sf_dir):
    """The ablated contrast under every assignment of heads to slow and fast."""
    t = Tables(spark, sf_dir)
    variants = [S.Regime("additive", "additive"), *S.partition_regimes()]
    return R.gap_contrasts(R.with_reach(S.score_long(seeds(t), variants, ["label"])))


@query(
    "regime_multipliers",
    "regime:s mean_score:f",
    with_ctes(
        "wide",
        "select 'additive' as regime, avg(score_additive * 0.8e0) as mean_score from wide union all"
        " select 'reflective_floor', avg(score_reflective_floor * 1.25e0) from wide",
    ),
)
def regime_multipliers(spark, sf_dir):
    """A multiplier per regime, as used to match budgets."""
    pair = [
        S.Regime("additive", "additive", multiplier=0.8),
        S.Regime("reflective_floor", "reflective_floor", multiplier=1.25),
    ]
    long = S.score_long(Tables(spark, sf_dir).view("seeds"), pair, [])
    return long.groupBy("regime").agg(F.avg("score").alias("mean_score"))


@query(
    "relative_scores_by_mean",
    "regime:s n:i rel_mean:f rel_max:f",
    with_ctes(
        "long",
        "select regime, count(*) as n, avg(rel) as rel_mean, max(rel) as rel_max from"
        " (select regime, score / avg(score) over (partition by regime) as rel from long) group by regime",
    ),
)
def relative_scores_by_mean(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = R.with_reach(S.score_long(seeds(t), S.all_regimes(), ["id"]), mode="mean")
    return rows.groupBy("regime").agg(
        F.count(F.lit(1)).alias("n"), F.avg("rel_score").alias("rel_mean"), F.max("rel_score").alias("rel_max")
    )


@query(
    "seed_reach",
    "id:i regime:s score:f rel_score:f reach:f",
    with_ctes("reach", "select * from reach"),
)
def seed_reach(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.with_reach(S.score_long(seeds(t), S.all_regimes(), ["id"]))


@query(
    "placebo_params",
    "q:f floor_fast:f scale_fast:f iqr_slow:f iqr_fast:f",
    with_ctes(
        "sums",
        """select q, quantile_cont(s_fast, q) as floor_fast, 0.5e0 * (f75 - f25) / (s75 - s25) as scale_fast,
        s75 - s25 as iqr_slow, f75 - f25 as iqr_fast from (
          select sorted[1 + cast(floor((n - 1) * q) as bigint)] + (sorted[1 + cast(ceil((n - 1) * q) as bigint)]
            - sorted[1 + cast(floor((n - 1) * q) as bigint)]) * ((n - 1) * q - floor((n - 1) * q)) as s_fast_q, * from (
          select avg(case when s_slow <= 1e0 then 1e0 else 0e0 end) as q, count(*) as n,
            list(s_fast order by s_fast) as sorted,
            quantile_cont(s_fast, 0.25) as f25, quantile_cont(s_fast, 0.75) as f75,
            quantile_cont(s_slow, 0.25) as s25, quantile_cont(s_slow, 0.75) as s75 from sums))""".replace(
            "quantile_cont(s_fast, q) as floor_fast", "s_fast_q as floor_fast"
        ),
    ),
)
def placebo_params(spark, sf_dir):
    return T.placebo_parameters(mechanism_seeds(Tables(spark, sf_dir)))


_GATED = """gated as (select *, case when sd = 0 then 0.5e0 else 1e0 / (1e0 + exp(-((p_cred - med) / sd))) end as g from wide,
  (select quantile_cont(p_cred, 0.5) as med, stddev_pop(p_cred) as sd,
     avg(score_additive) as ma, stddev_pop(score_additive) as sa, avg(p_cred) as mc from wide) as st)"""


@query(
    "content_gates",
    "id:i gate_quality:f tempered_half:f tail_10:f tail_20:f naive_sum:f gated:f combined:f",
    with_ctes(
        "wide",
        "",
    ).rstrip()
    + f", {_GATED} select id, g as gate_quality, pow(g, 0.5e0) as tempered_half,"
    " case when t1 > 0 then least(1e0, g / t1) else 1e0 end as tail_10,"
    " case when t2 > 0 then least(1e0, g / t2) else 1e0 end as tail_20,"
    " (score_additive - ma) / sa + (p_cred - mc) / sd as naive_sum,"
    " score_additive * g as gated, score_reflective_floor * g as combined"
    " from gated, (select quantile_cont(g, 0.1) as t1, quantile_cont(g, 0.2) as t2 from gated) as tails",
)
def content_gates(spark, sf_dir):
    """Quality gate, tempered and tail versions, and the forms that use it."""
    base = mechanism_seeds(Tables(spark, sf_dir))
    gated = T.quality_gate(base, "p_cred")
    gated = T.tail_gates(gated, "gate_quality")
    gated = T.zscores(gated, {"score_additive": "z_additive", "p_cred": "z_credibility"})
    return gated.select(
        "id", "gate_quality", T.tempered("gate_quality", 0.5).alias("tempered_half"),
        "tail_10", "tail_20",
        *[c.alias(n) for n, c in T.content_forms().items()],
    )


@query(
    "reach_table",
    "regime:s low_mean:f high_mean:f gap:f low_reduction_pct:f high_reduction_pct:f selectivity:f",
    with_ctes(
        "gaps",
        """select g.regime, g.low_mean, g.high_mean, g.gap,
        100e0 * (b.low_mean - g.low_mean) / b.low_mean as low_reduction_pct,
        100e0 * (b.high_mean - g.high_mean) / b.high_mean as high_reduction_pct,
        100e0 * (b.low_mean - g.low_mean) / b.low_mean - 100e0 * (b.high_mean - g.high_mean) / b.high_mean as selectivity
        from gaps g, gaps b where b.regime = 'additive'""",
    ),
)
def reach_table(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.reach_table(R.with_reach(S.score_long(seeds(t), S.all_regimes(), ["label"])))


_CURVE = with_ctes("sums", "").rstrip() + """, swept as (
  select label, f.floor, case when f.floor < 0 then score_additive
    else score_additive * (1e0 / (1e0 + exp(-((s_slow - f.floor) / 0.5e0)))) end as score
  from sums, (select -1e0 as floor union all select round(i / 1e1, 1) from range(26) as r(i)) as f
), placed as (
  select label, s.floor, least(greatest(200e0 * (score / ref), 0e0), 50000e0) as reach
  from swept s join (select floor, quantile_cont(score, 0.5) as ref from swept group by floor) r using (floor)
), classes as (
  select floor, lo as low_mean, hi as high_mean, lo - hi as gap, lo / ((lo + hi) / 2e0) as ls, hi / ((lo + hi) / 2e0) as hs
  from (select floor, avg(reach) filter (label = 'low_credibility') as lo, avg(reach) filter (label = 'high_credibility') as hi
        from placed group by floor)
), curve as (
  select c.floor, c.low_mean, c.high_mean, 100e0 * (1e0 - c.ls / b.ls) as low_reduction_pct,
    100e0 * (1e0 - c.hs / b.hs) as high_reduction_pct,
    100e0 * (1e0 - c.ls / b.ls) - 100e0 * (1e0 - c.hs / b.hs) as selectivity,
    c.gap, c.gap - b.gap as gap_change, c.ls - c.hs as gap_share
  from classes c, classes b where b.floor < 0 and c.floor >= 0
)"""
_CURVE_SPEC = (
    "floor:f low_mean:f high_mean:f low_reduction_pct:f high_reduction_pct:f selectivity:f gap:f gap_change:f gap_share:f"
)


@query("operating_curve", _CURVE_SPEC, _CURVE + " select * from curve")
def operating_curve(spark, sf_dir):
    return R.operating_curve(seeds(Tables(spark, sf_dir)))


@query(
    "operating_points",
    f"choice:s {_CURVE_SPEC}",
    _CURVE + """ select * from (select 'selectivity' as choice, * from curve order by selectivity desc, floor limit 1)
    union all select 'budget', c.* from (select 1) left join
      (select * from curve where high_reduction_pct <= 10 order by low_reduction_pct desc, floor limit 1) c on true""",
)
def operating_points(spark, sf_dir):
    return R.operating_points(R.operating_curve(seeds(Tables(spark, sf_dir))))


@query(
    "operating_anchor",
    "got:f target:f abs_diff:f matched:b",
    _CURVE + """ select gap_change as got, -37.8e0 as target, abs(gap_change + 37.8e0) as abs_diff,
      abs(gap_change + 37.8e0) <= 3e0 as matched from curve where floor = 1""",
)
def operating_anchor(spark, sf_dir):
    """The published anchor at floor 1; these tables are not its corpus, so it need not match."""
    curve = R.operating_curve(seeds(Tables(spark, sf_dir))).where(F.abs(F.col("floor") - 1.0) < 1e-9)
    return C.anchor_check(curve, "gap_change", -37.8, 3.0)


_PLAN = with_ctes("reach posts", "").rstrip() + """, clock as (
  select cast(floor(epoch / 36e2) as bigint) % 24 as hour, count(*) as n from posts group by 1
), weights as (
  select h as hour, coalesce(n, 0) * (24e0 / sum(n) over ()) as weight
  from range(24) as r(h) left join clock on h = hour
), shape as (
  select r.id, r.reach, r.p_reply, r.p_retweet, r.p_like, r.p_deep, b.t as t_hour, exp(-b.t / 6e0) * w.weight as part
  from (select r.*, s.epoch from reach r join posts s on r.id = s.id where regime = 'additive') r, range(24) as b(t)
  join weights w on w.hour = (cast(floor(r.epoch / 36e2) as bigint) + b.t) % 24
), planned as (select *, part / sum(part) over (partition by id) * reach as planned from shape)"""


@query("diurnal_weights", "hour:i weight:f", _PLAN + " select * from weights")
def diurnal_weights(spark, sf_dir):
    return P.diurnal_weights(Tables(spark, sf_dir).view("posts"))


def _plan(t: Tables):
    long = S.score_long(seeds(t), regimes(["additive"]), ["id", "epoch", *[f"p_{h}" for h in K.HEADS]])
    keep = ["id", *[f"p_{h}" for h in K.HEADS]]
    return R.hourly_plan(R.with_reach(long), P.diurnal_weights(t.view("posts")), keep=keep)


@query("hourly_plan", "id:i t_hour:i planned:f", _PLAN + " select * from planned")
def hourly_plan(spark, sf_dir):
    return _plan(Tables(spark, sf_dir))


@query(
    "expected_engagement",
    "t_hour:i reply:g retweet:g like_count:g deep:g",
    _PLAN + """ select t_hour, sum(planned * p_reply) as reply, sum(planned * p_retweet) as retweet,
      sum(planned * p_like) as like_count, sum(planned * p_deep) as deep from planned group by t_hour""",
)
def expected_engagement(spark, sf_dir):
    """Expected events per hour and head, summed over seeds."""
    rows = R.expected_engagement(_plan(Tables(spark, sf_dir)), ["id"])
    return rows.groupBy("t_hour").agg(
        F.sum("expected_reply").alias("reply"), F.sum("expected_retweet").alias("retweet"),
        F.sum("expected_like").alias("like_count"), F.sum("expected_deep").alias("deep"),
    )


def _vectors_sql() -> str:
    rows = []
    for i, w in enumerate([*W.named_weights().values(), *W.weight_grid()]):
        d = W.describe_weights(w)
        null = "null"
        rows.append(
            f"({i}, {w['reply']!r}::double, {w['retweet']!r}::double, {w['like']!r}::double, {w['deep']!r}::double, "
            f"{d['fast_share']!r}::double)".replace("None", null)
        )
    return ", ".join(rows)


_GRID = with_ctes("gaps", "").rstrip() + f""", vectors(v, wr, wt, wl, wd, fast_share) as (values {_vectors_sql()}),
pub as (select id, label, p_reply, p_retweet, p_like, p_deep,
  rank() over (order by score_additive) + (count(*) over (partition by score_additive) - 1) / 2e0 as rank_pub from wide),
scored as (select v, label, rank_pub, p_reply * wr + p_retweet * wt + p_like * wl + p_deep * wd as s from pub, vectors),
medians as (select v, quantile_cont(s, 0.5) as m from scored group by v),
swept as (select v, avg(r) filter (label = 'low_credibility') as low_mean, avg(r) filter (label = 'high_credibility') as high_mean
  from (select v, label, case when m > 0 then least(greatest(200e0 * (s / m), 0e0), 50000e0) else 200e0 end as r
        from scored join medians using (v)) group by v),
anchor as (select max(gap) filter (regime = 'additive') as a, max(gap) filter (regime = 'reflective_floor') as f from gaps),
grid as (select v, fast_share, low_mean - high_mean as gap, low_mean - high_mean - a as closure,
  (low_mean - high_mean - a) / (f - a) as closure_of_floor from swept join vectors using (v), anchor)"""


def _all_vectors() -> list[dict[str, float]]:
    return [*W.named_weights().values(), *W.weight_grid()]


@query("weight_grid", "v:i fast_share:f gap:f closure:f closure_of_floor:f", _GRID + " select * from grid")
def weight_grid(spark, sf_dir):
    """Gap and closure of the five named and 2,128 grid vectors."""
    return W.closure_table(seeds(Tables(spark, sf_dir)), _all_vectors())


@query(
    "closing_region",
    "threshold_pct:i n_vectors:i min_fast_share:f max_fast_share:f argmin_v:i",
    _GRID + """ select p as threshold_pct, count(*) filter (closure_of_floor >= p / 1e2) as n_vectors,
      min(fast_share) filter (closure_of_floor >= p / 1e2) as min_fast_share,
      max(fast_share) filter (closure_of_floor >= p / 1e2) as max_fast_share,
      arg_min(v, (fast_share, v)) filter (closure_of_floor >= p / 1e2) as argmin_v
      from grid, (values (50), (80), (100)) as t(p) group by p""",
)
def closing_region(spark, sf_dir):
    return W.closing_region(W.closure_table(seeds(Tables(spark, sf_dir)), _all_vectors()))


@query(
    "weight_rank_agreement",
    "v:i rho:f",
    _GRID + """ select v, corr(r, rank_pub) as rho from (
      select v, rank_pub, rank() over (partition by v order by s) + (count(*) over (partition by v, s) - 1) / 2e0 as r
      from scored) group by v""",
)
def weight_rank_agreement(spark, sf_dir):
    """Rank agreement of the named and all grid vectors with the published one, over all seeds."""
    return W.rank_agreement(seeds(Tables(spark, sf_dir)), _all_vectors())


def _point_vectors() -> dict[str, dict[str, float]]:
    return {**{n: w for n, w in W.named_weights().items() if n != "published"}, "published_2026": W.PUBLISHED_2026}


def _points_sql() -> str:
    each = {"published": W.named_weights()["published"], **_point_vectors()}
    low, high = "filter (label = 'low_credibility')", "filter (label = 'high_credibility')"
    n = len(each)

    def gaps(w: str) -> str:
        return ", ".join(f"sum({w} * r{i}) {low} / sum({w}) {low} - sum({w} * r{i}) {high} / sum({w}) {high} as g{i}" for i in range(n))

    score = [" + ".join(f"p_{h} * {w[h]!r}" for h in ("reply", "retweet", "like", "deep")) for w in each.values()]
    cells = ", ".join(f"('{name}', g{i} - g0, g{i})" for i, name in enumerate(each) if i)
    shares = ", ".join(f"('{name}', {W.describe_weights(w)['fast_share']!r})" for name, w in each.items())
    rhos = " union all ".join(
        f"select '{name}' as name, corr(r, rank_pub) as rho from (select rank_pub, rank() over (order by s{i}) + (count(*) over (partition by s{i}) - 1) / 2e0 as r from"
        f" (select s{i}, rank() over (order by s0) + (count(*) over (partition by s0) - 1) / 2e0 as rank_pub from scored))" for i, name in enumerate(each) if i)
    return with_ctes("gaps", "").rstrip() + f""", scored as (select id, label, {", ".join(f"{x} as s{i}" for i, x in enumerate(score))} from seeds),
    medians as (select {", ".join(f"quantile_cont(s{i}, 0.5) as m{i}" for i in range(n))} from scored),
    src as (select id as cascade_id, label, {", ".join(f"least(greatest(200e0 * (s{i} / m{i}), 0e0), 50000e0) as r{i}" for i in range(n))}
      from scored, medians where label in ('low_credibility', 'high_credibility')),
    points as (select unnest([{cells}]) as c from (select {gaps("1e0")} from src)),
    cells as (select unnest([{cells}]) as c from (select replicate, {gaps("w")} from ({poisson_draws_sql("src", N_BOOT)}) group by replicate)),
    ci as (select c[1] as name, quantile_cont(c[2], 0.025) as ci_lo, quantile_cont(c[2], 0.975) as ci_hi from cells group by 1),
    anchor as (select max(gap) filter (regime = 'additive') as a, max(gap) filter (regime = 'reflective_floor') as f from gaps),
    shares(name, fast_share) as (values {shares}), rhos as ({rhos})
    select p.c[1] as name, fast_share, p.c[3] as gap, p.c[2] as closure, p.c[2] / (f - a) as closure_of_floor, rho, ci_lo, ci_hi
    from points p join ci on ci.name = p.c[1] join shares on shares.name = p.c[1] join rhos on rhos.name = p.c[1], anchor"""


@query("weight_points", "name:s fast_share:f gap:f closure:f closure_of_floor:f rho:f ci_lo:f ci_hi:f", _points_sql())
def weight_points(spark, sf_dir):
    """Gap, closure with its interval and rank agreement of named vectors and of one published later."""
    base, each = seeds(Tables(spark, sf_dir)), _point_vectors()
    vectors = list(each.values())
    names = F.element_at(F.array(*[F.lit(n) for n in each]), F.col("v") + 1)
    table = W.closure_table(base, vectors).join(W.rank_agreement(base, vectors), "v").withColumn("name", names)
    return table.join(W.closure_intervals(base, each, N_BOOT).drop("point"), "name")


_SUBSTANCE = with_ctes("activity", "").rstrip() + """, feats as (
  select id, ln(1e0 + user_followersCount) as a, ln(1e0 + user_listedCount) as b,
    ln((user_followersCount + 1e0) / (user_friendsCount + 1e0)) as c, ln(1e0 + length(rawContent)) as d,
    case when user_blue then 1e0 else 0e0 end as e from activity
), z as (select id, ((a - avg(a) over ()) / greatest(stddev_pop(a) over (), 1e-9) + (b - avg(b) over ()) / greatest(stddev_pop(b) over (), 1e-9)
  + (c - avg(c) over ()) / greatest(stddev_pop(c) over (), 1e-9) + (d - avg(d) over ()) / greatest(stddev_pop(d) over (), 1e-9)
  + (e - avg(e) over ()) / greatest(stddev_pop(e) over (), 1e-9)) / 5e0 as z_substance from feats)"""


def substance(t: Tables):
    posts = t.view("activity").withColumn("link_urls", F.array().cast("array<string>"))
    cols = feature_columns(posts)
    feats = posts.select("id", *[cols[c].alias(c) for c in K.SUBSTANCE_FEATURES])
    return with_substance(feats, substance_stats(feats)).select("id", "z_substance")


@query("substance_index", "id:i z_substance:f", _SUBSTANCE + " select * from z")
def substance_index(spark, sf_dir):
    return substance(Tables(spark, sf_dir))


@query(
    "floor_x_substance",
    "id:i score:f",
    with_ctes("wide activity", "").rstrip()
    + _SUBSTANCE[_SUBSTANCE.index(", feats as (") :]
    + " select w.id, score_reflective_floor * (1e0 / (1e0 + exp(-z_substance))) as score from wide w join z using (id)",
)
def floor_x_substance(spark, sf_dir):
    """The floor score gated once more by the author substance index."""
    t = Tables(spark, sf_dir)
    joined = t.view("seeds").join(substance(t), "id")
    return joined.select("id", S.Regime("both", "floor_x_substance").score().alias("score"))


_ALPHAS = {"F1": (0.25, 0.5, 1.0, 2.0, 4.0, 8.0), "F2": (0.25, 0.5, 1.0, 2.0, 4.0)}
_FLOORS = tuple((f, s) for f in (0.5, 1.0, 1.5, 2.0) for s in (0.25, 0.5, 1.0))


def _sweep_grid() -> list[tuple[str, S.Regime]]:
    grid = [("F1", S.Regime(f"ablated:{a:.2f}", "ablated", alpha=a)) for a in _ALPHAS["F1"]]
    grid += [("F2", S.Regime(f"ratio:{a:.2f}", "ratio_correction", alpha=a)) for a in _ALPHAS["F2"]]
    return grid + [("F3", S.Regime(f"floor:{f:.1f}:{w:.2f}", "reflective_floor", floor=f, floor_scale=w)) for f, w in _FLOORS]


def _sweep_sql() -> str:
    """Scores, medians and both metrics in wide form; one weight per (row, draw) serves all of them."""
    score = {"additive": "score_additive"}
    for form, r in _sweep_grid():
        score[r.name] = {
            "F1": f"s_slow * (1e0 + {r.alpha!r} * s_fast)",
            "F2": f"score_additive / (1e0 + {r.alpha!r} * (s_fast / (s_slow + 1e-6)))",
            "F3": f"score_additive * (1e0 / (1e0 + exp(-((s_slow - {r.floor!r}) / {r.floor_scale!r}))))",
        }[form]
    names = list(score)
    reach = [f"least(greatest(200e0 * (s{i} / m{i}), 0e0), 50000e0)" for i in range(len(names))]
    cells = [(i, m) for i in range(len(names)) for m in ("reach", "size")]
    low, high = "filter (label = 'low_credibility')", "filter (label = 'high_credibility')"

    def gaps(w: str) -> str:
        return ", ".join(f"sum({w} * {m}{i}) {low} / sum({w}) {low} - sum({w} * {m}{i}) {high} / sum({w}) {high} as g_{m}{i}" for i, m in cells)

    form = {r.name: f for f, r in _sweep_grid()}
    rows = ", ".join(f"('{form[n]}', '{n}', '{m}', g_{m}{i} - g_{m}0)" for i, n in enumerate(names) if i for m in ("reach", "size"))
    return with_ctes("sums", "").rstrip() + f""", scored as (select id, label, p_reply + p_retweet + p_deep as p, {", ".join(f"{score[n]} as s{i}" for i, n in enumerate(names))} from sums),
    medians as (select {", ".join(f"quantile_cont(s{i}, 0.5) as m{i}" for i in range(len(names)))} from scored),
    src as (select id as cascade_id, label, {", ".join(f"{x} as reach{i}, {x} * p as size{i}" for i, x in enumerate(reach))}
      from scored, medians where label in ('low_credibility', 'high_credibility')),
    point as (select {gaps("1e0")} from src),
    draws as (select replicate, {gaps("w")} from ({poisson_draws_sql("src", N_BOOT)}) group by replicate),
    points as (select unnest([{rows}]) as c from point),
    cells as (select unnest([{rows}]) as c from draws)
    select p.c[1] as form, p.c[2] as regime, p.c[3] as metric, p.c[4] as point, d.lo as ci_lo, d.hi as ci_hi,
      case when d.hi < 0 then 'neg' when d.lo > 0 then 'pos' else 'overlaps_0' end as sign
    from points p join (select c[2] as regime, c[3] as metric, quantile_cont(c[4], 0.025) as lo, quantile_cont(c[4], 0.975) as hi
      from cells group by 1, 2) d on d.regime = p.c[2] and d.metric = p.c[3]"""


@query("hyperparameter_sweep", "form:s regime:s metric:s point:f ci_lo:f ci_hi:f sign:s", _sweep_sql())
def hyperparameter_sweep(spark, sf_dir):
    """Reach and size contrast of three forms over their parameter grids, with paired bootstrap intervals.

    All grid points are columns, so a batch of rows meets one matrix of weights.
    """
    grid = _sweep_grid()
    base = seeds(Tables(spark, sf_dir))
    regimes = [S.Regime("additive", "additive"), *[r for _, r in grid]]
    # A number a grid point: parameters of the wide expressions.
    median = {r["regime"]: r["reference"] for r in R.score_reference(S.score_long(base, regimes, ["label"])).collect()}
    size = F.col("p_reply") + F.col("p_retweet") + F.col("p_deep")
    reach = {r.name: R.exposure(r.score(), F.lit(median[r.name])) for r in regimes}
    wide = base.select(
        F.col("id").alias("cascade_id"), "label",
        *[x.alias(f"reach{i}") for i, x in enumerate(reach.values())], *[(x * size).alias(f"size{i}") for i, x in enumerate(reach.values())])
    pairs = {f"{m}|{r.name}": (f"{m}0", f"{m}{i}") for m in ("reach", "size") for i, r in enumerate(regimes) if i}
    found = C.bootstrap_contrasts(stage(wide, "sweep"), pairs, N_BOOT).withColumn("sign", C.interval_sign())
    form = F.create_map(*[F.lit(x) for f, r in grid for x in (r.name, f)])
    regime = F.substring_index("name", "|", -1)
    return found.select(form[regime].alias("form"), regime.alias("regime"), F.substring_index("name", "|", 1).alias("metric"), "point", "ci_lo", "ci_hi", "sign")


@query(
    "score_recheck",
    "max_abs_dev:f",
    with_ctes("sums", "select max(abs(s_slow + s_fast - score_additive)) as max_abs_dev from sums"),
)
def score_recheck(spark, sf_dir):
    """Slow plus fast must give the additive score again."""
    m = S.mechanism(Tables(spark, sf_dir).view("seeds"))
    return C.max_deviation(m, F.col("s_slow") + F.col("s_fast"), F.col("score_additive"), 1e-6)
