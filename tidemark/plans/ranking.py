"""Queries on ranks, demotion, targeting and two-sample statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions import scoring as S
from tidemark.functions.columns import share
from tidemark.operators import compare as M
from tidemark.operators import profiles as P
from tidemark.operators import ranks as N
from tidemark.operators import targeting as T
from tidemark.plans.panel import mechanism_seeds
from tidemark.plans.registry import query
from tidemark.plans.views import Tables, average_rank_sql, percent_rank_sql, with_ctes
from tidemark.session import passing, stage

_FORMS = {"reflective_floor": "score_reflective_floor", "ablated": "score_ablated", "complementary": "score_complementary"}

_LONG = with_ctes("wide", "").rstrip() + ", forms as (" + " union all ".join(
    f"select id, label, flagged, followers, fast_share, s_slow, s_fast, gate, p_cred, score_additive, '{n}' as form, {c} as form_score from wide"
    for n, c in _FORMS.items()
) + f"""), ranked as (select *, {percent_rank_sql('score_additive', 'form')} as rank_additive,
  {percent_rank_sql('form_score', 'form')} as rank_form from forms),
  demoted as (select *, rank_additive - rank_form as demotion from ranked)"""


def _forms(t: Tables):
    complementary = S.Regime("complementary", "complementary").score()
    base = stage(mechanism_seeds(t).withColumn("score_complementary", complementary), "scored")
    keep = ["id", "label", "flagged", "followers", "fast_share", "s_slow", "s_fast", "gate", "p_cred", "score_additive"]
    return T.demotion_long(base, "score_additive", {n: F.col(c) for n, c in _FORMS.items()}, keep)


@query(
    "percentile_ranks",
    "id:i avg_rank:f unit_rank:f pct_rank:f",
    with_ctes(
        "sums",
        f"""select id, {average_rank_sql('score_additive')} as avg_rank,
        {average_rank_sql('score_additive')} / count(*) over () as unit_rank,
        {percent_rank_sql('score_additive')} as pct_rank from sums""",
    ),
)
def percentile_ranks(spark, sf_dir):
    df = mechanism_seeds(Tables(spark, sf_dir)).select("id", "score_additive")
    for kind, name in (("average", "avg_rank"), ("unit", "unit_rank"), ("percent", "pct_rank")):
        df = N.attach_ranks(df, {"score_additive": name}, kind)
    return df


@query(
    "demotion",
    "id:i form:s rank_additive:f rank_form:f demotion:f",
    _LONG + " select * from demoted",
)
def demotion(spark, sf_dir):
    return _forms(Tables(spark, sf_dir))


@query(
    "rank_displacement",
    "id:i rank_additive:f disp_ablated:f disp_floor:f",
    with_ctes(
        "wide",
        f"""select id, {average_rank_sql('score_additive')} / count(*) over () as rank_additive,
        {average_rank_sql('score_ablated')} / count(*) over () - {average_rank_sql('score_additive')} / count(*) over () as disp_ablated,
        {average_rank_sql('score_reflective_floor')} / count(*) over () - {average_rank_sql('score_additive')} / count(*) over () as disp_floor
        from wide""",
    ),
)
def rank_displacement(spark, sf_dir):
    m = mechanism_seeds(Tables(spark, sf_dir))
    d = T.displacement(m, "score_additive", ["score_ablated", "score_reflective_floor"])
    return d.select(
        "id", F.col("rank_score_additive").alias("rank_additive"),
        F.col("disp_score_ablated").alias("disp_ablated"), F.col("disp_score_reflective_floor").alias("disp_floor"),
    )


_COMPARISON = with_ctes("wide", "").rstrip() + f""", disp as (select *, score_ablated / (score_additive + 1e-12) as mult_ablated,
    score_reflective_floor / (score_additive + 1e-12) as mult_floor,
    {average_rank_sql('score_ablated')} / count(*) over () - {average_rank_sql('score_additive')} / count(*) over () as disp_ablated,
    {average_rank_sql('score_reflective_floor')} / count(*) over () - {average_rank_sql('score_additive')} / count(*) over () as disp_floor from wide),
  measures as (""" + " union all ".join(
    f"select '{n}' as measure, avg({e}) filter (label = 'low_credibility') as low, avg({e}) filter (label = 'high_credibility') as high from disp"
    for n, e in {
        "s_slow": "s_slow", "s_fast": "s_fast", "gate": "gate",
        "gate_below_half": "case when gate < 0.5e0 then 1e0 else 0e0 end",
        "mult_ablated": "mult_ablated", "mult_floor": "mult_floor",
        "disp_ablated": "disp_ablated", "disp_floor": "disp_floor",
        "demoted_ablated": "case when disp_ablated < 0 then 1e0 else 0e0 end",
        "demoted_floor": "case when disp_floor < 0 then 1e0 else 0e0 end",
    }.items()
) + ")"


def _class_table(t: Tables):
    d = T.displacement(mechanism_seeds(t), "score_additive", ["score_ablated", "score_reflective_floor"])
    d = d.withColumnsRenamed({"disp_score_ablated": "disp_ablated", "disp_score_reflective_floor": "disp_floor"})
    c = F.col
    return P.class_comparison(
        d,
        {
            "s_slow": c("s_slow"), "s_fast": c("s_fast"), "gate": c("gate"), "gate_below_half": c("gate") < 0.5,
            "mult_ablated": c("mult_ablated"), "mult_floor": c("mult_floor"),
            "disp_ablated": c("disp_ablated"), "disp_floor": c("disp_floor"),
            "demoted_ablated": c("disp_ablated") < 0, "demoted_floor": c("disp_floor") < 0,
        },
    )


@query(
    "class_comparison",
    "measure:s low:f high:f low_minus_high:f",
    _COMPARISON + " select *, low - high as low_minus_high from measures",
)
def class_comparison(spark, sf_dir):
    return _class_table(Tables(spark, sf_dir))


@query(
    "mechanism_verdicts",
    "low_lower_gate:b low_more_suppressed:b low_more_displaced_ablated:b low_more_displaced_floor:b demotes_low_more:b",
    _COMPARISON + """ select *, low_lower_gate and low_more_suppressed and low_more_displaced_ablated and low_more_displaced_floor as demotes_low_more
      from (select bool_or(low < high) filter (measure = 'gate') as low_lower_gate,
        bool_or(low > high) filter (measure = 'gate_below_half') as low_more_suppressed,
        bool_or(low < high) filter (measure = 'disp_ablated') as low_more_displaced_ablated,
        bool_or(low < high) filter (measure = 'disp_floor') as low_more_displaced_floor from measures)""",
)
def mechanism_verdicts(spark, sf_dir):
    return P.mechanism_verdicts(_class_table(Tables(spark, sf_dir)))


_TARGET = _LONG + f""", known as (select *, {average_rank_sql('fast_share', 'form')} as rs, {average_rank_sql('demotion', 'form')} as rd
    from demoted where fast_share is not null),
  cuts as (select form, quantile_cont(demotion, 0.25) as q25, quantile_cont(demotion, 0.75) as q75,
    quantile_cont(fast_share, 0.1) as d10, quantile_cont(fast_share, 0.9) as d90, quantile_cont(s_slow, 2e0/3e0) as slow66 from known group by form)"""


@query(
    "targeting_metrics",
    "form:s n:i rho:f top_quarter_low_share:f bottom_quarter_low_share:f top_quarter_fast_share:f"
    " bottom_quarter_fast_share:f demotion_top_tenth:f demotion_bottom_tenth:f",
    _TARGET + """ select form, count(*) as n, corr(rs, rd) as rho,
      avg(case when label = 'low_credibility' then 1e0 else 0e0 end) filter (demotion >= q75) as top_quarter_low_share,
      avg(case when label = 'low_credibility' then 1e0 else 0e0 end) filter (demotion <= q25) as bottom_quarter_low_share,
      avg(fast_share) filter (demotion >= q75) as top_quarter_fast_share,
      avg(fast_share) filter (demotion <= q25) as bottom_quarter_fast_share,
      avg(demotion) filter (fast_share >= d90) as demotion_top_tenth,
      avg(demotion) filter (fast_share <= d10) as demotion_bottom_tenth
      from known join cuts using (form) group by form""",
)
def targeting_metrics(spark, sf_dir):
    return T.targeting_metrics(_forms(Tables(spark, sf_dir)))


@query(
    "targeting_specificity",
    "form:s label:s n:i mean_demotion:f",
    _TARGET + """ select form, label, count(*) as n, avg(demotion) as mean_demotion from known join cuts using (form)
      where s_slow >= slow66 and label in ('low_credibility', 'high_credibility') group by form, label""",
)
def targeting_specificity(spark, sf_dir):
    return T.specificity(_forms(Tables(spark, sf_dir)))


@query(
    "spearman",
    "label:s rho:f n:i",
    with_ctes(
        "wide",
        f"""select label, corr(a, b) as rho, count(*) as n from (select label, {average_rank_sql('fast_share', 'label')} as a,
        {average_rank_sql('score_additive', 'label')} as b from wide where label is not null and fast_share is not null) group by label""",
    ),
)
def spearman(spark, sf_dir):
    m = mechanism_seeds(Tables(spark, sf_dir)).where("label is not null")
    return M.spearman(m, "fast_share", "score_additive", ["label"])


@query("spearman_p", "label:s rho:f n:i p_value:f")
def spearman_p(spark, sf_dir):
    m = mechanism_seeds(Tables(spark, sf_dir)).where("label is not null")
    return M.spearman(m, "followers", "score_additive", ["label"], p_value=True)


def _ratio_level_rows(t: Tables):
    d = _forms(t).where(F.col("form") == "reflective_floor")
    return stage(d.withColumn("ratio", F.col("s_fast") / (F.col("s_slow") + F.lit(1e-3))).withColumn("level", F.col("s_slow") + F.col("s_fast")), "ratio-level")


_RL = _LONG + """, rl as (select id, label, demotion, s_fast / (s_slow + 1e-3) as ratio, s_slow + s_fast as level
    from demoted where form = 'reflective_floor'),
  grouped as (select 'all' as class, * from rl union all select label as class, * from rl where label in ('low_credibility', 'high_credibility'))"""


@query(
    "ratio_level",
    "class:s n:i rho_demotion_ratio:f rho_demotion_level:f rho_ratio_level:f partial_demotion_ratio:f partial_demotion_level:f",
    _RL + f""" select class, n, xy as rho_demotion_ratio, xz as rho_demotion_level, yz as rho_ratio_level,
      (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) as partial_demotion_ratio,
      (xz - xy * yz) / sqrt((1 - xy * xy) * (1 - yz * yz)) as partial_demotion_level
      from (select class, count(*) as n, corr(x, y) as xy, corr(x, z) as xz, corr(y, z) as yz from
        (select class, {average_rank_sql('demotion', 'class')} as x, {average_rank_sql('ratio', 'class')} as y,
          {average_rank_sql('level', 'class')} as z from grouped) group by class)""",
)
def ratio_level(spark, sf_dir):
    """Overall and by class, as keys of one job."""
    rows = _ratio_level_rows(Tables(spark, sf_dir))
    classes = F.when(F.col("label").isin(K.LOW, K.HIGH), F.array(F.lit("all"), F.col("label"))).otherwise(F.array(F.lit("all")))
    keyed = rows.select("demotion", "ratio", "level", F.explode(classes).alias("class"))
    return T.ratio_level(keyed, "demotion", "ratio", "level", ["class"])


@query("ratio_level_p", "n:i partial_xy_z:f p_partial_xy_z:f partial_xz_y:f p_partial_xz_y:f")
def ratio_level_p(spark, sf_dir):
    rows = _ratio_level_rows(Tables(spark, sf_dir))
    return M.partial_spearman(rows, "demotion", "ratio", "level", p_value=True)


@query(
    "within_level",
    "stratum:i n:i skipped:b mean_level:f mean_demotion:f rho:f n_top:i n_bottom:i top_mean:f bottom_mean:f top_minus_bottom:f",
    _RL + f""", edged as (select *, case when level <= e1 then 1 when level <= e2 then 2 when level <= e3 then 3 when level <= e4 then 4 else 5 end as stratum
        from rl, (select quantile_cont(level, 0.2) as e1, quantile_cont(level, 0.4) as e2, quantile_cont(level, 0.6) as e3, quantile_cont(level, 0.8) as e4 from rl)),
      cut as (select stratum, quantile_cont(ratio, 1e0/3e0) as t33, quantile_cont(ratio, 2e0/3e0) as t66 from edged group by stratum)
      select stratum, count(*) as n, false as skipped, avg(level) as mean_level, avg(demotion) as mean_demotion, corr(a, b) as rho,
        count(*) filter (ratio >= t66) as n_top, count(*) filter (ratio <= t33) as n_bottom,
        avg(demotion) filter (ratio >= t66) as top_mean, avg(demotion) filter (ratio <= t33) as bottom_mean,
        avg(demotion) filter (ratio >= t66) - avg(demotion) filter (ratio <= t33) as top_minus_bottom
      from (select *, {average_rank_sql('ratio', 'stratum')} as a, {average_rank_sql('demotion', 'stratum')} as b from edged join cut using (stratum))
      group by stratum""",
)
def within_level(spark, sf_dir):
    return T.within_level(_ratio_level_rows(Tables(spark, sf_dir)), "demotion", "ratio", "level")


@query(
    "rank_retention",
    "form:s n:i mean_final_rank:f share_top_half:f share_top_quarter:f",
    _LONG + """ select form, count(*) as n, avg(rank_form) as mean_final_rank,
      avg(case when rank_form > 50 then 1e0 else 0e0 end) as share_top_half,
      avg(case when rank_form > 75 then 1e0 else 0e0 end) as share_top_quarter
      from demoted, (select quantile_cont(score_additive, 2e0/3e0) as q from wide)
      where flagged and score_additive > q group by form""",
)
def rank_retention(spark, sf_dir):
    """Where high-engagement flagged rows end up."""
    t = Tables(spark, sf_dir)
    forms = _forms(t)
    q = N.quantile_scalars(mechanism_seeds(t), "score_additive", {"q": 2.0 / 3.0}).getField("q")
    return T.rank_retention(forms.withColumn("__q", q), F.col("flagged") & (F.col("score_additive") > F.col("__q")))


@query(
    "most_demoted_decile",
    "class:s n_top:i share:f baseline_share:f enrichment:f",
    _LONG + """, pooled as (select id, coalesce(label, 'unlabeled') as class, demotion from demoted
        where form = 'reflective_floor' and (label is null or label <> 'mixed')),
      marked as (select *, row_number() over (order by demotion desc, id desc) <= n // 10 as top, n
        from pooled, (select count(*) as n from pooled))
      select class, n_top, n_top / (n // 10) as share, n_all / n as baseline_share, (n_top / (n // 10)) / (n_all / n) as enrichment
      from (select class, count(*) filter (top) as n_top, count(*) as n_all, max(n) as n from marked group by class)""",
)
def most_demoted_decile(spark, sf_dir):
    """Who fills the most demoted tenth, unlabelled rows included?"""
    rows = _forms(Tables(spark, sf_dir)).where("form = 'reflective_floor' and (label is null or label <> 'mixed')")
    pooled = stage(rows.select("id", F.coalesce("label", F.lit("unlabeled")).alias("class"), "demotion"), "pooled")
    return P.decile_composition(pooled, "demotion", "class", "id")


@query(
    "demotion_by_class",
    "class:s count:i mean:f median:f q10:f q90:f share_above:f share_below:f",
    _LONG + """ select class, count(*) as count, avg(demotion) as mean, quantile_cont(demotion, 0.5) as median,
      quantile_cont(demotion, 0.1) as q10, quantile_cont(demotion, 0.9) as q90,
      avg(case when demotion > 1 then 1e0 else 0e0 end) as share_above, avg(case when demotion < -1 then 1e0 else 0e0 end) as share_below
      from (select coalesce(label, 'unlabeled') as class, demotion from demoted where form = 'reflective_floor') group by class""",
)
def demotion_by_class(spark, sf_dir):
    rows = _forms(Tables(spark, sf_dir)).where("form = 'reflective_floor'")
    return P.group_summary(rows.select(F.coalesce("label", F.lit("unlabeled")).alias("class"), "demotion"), "demotion", ["class"])


@query(
    "collateral_split",
    "demoted:b metric:s count:i mean:f median:f q10:f q90:f",
    _LONG + """ select demotion > 1 as demoted, metric, count(*) as count, avg(v) as mean, quantile_cont(v, 0.5) as median,
      quantile_cont(v, 0.1) as q10, quantile_cont(v, 0.9) as q90 from (
        select demotion, unnest(['fast_share', 's_slow', 's_fast']) as metric, unnest([fast_share, s_slow, s_fast]) as v
        from demoted where form = 'reflective_floor' and label is null) where v is not null group by 1, 2""",
)
def collateral_split(spark, sf_dir):
    """Unlabelled rows: what sets the demoted ones apart?"""
    rows = _forms(Tables(spark, sf_dir)).where("form = 'reflective_floor' and label is null")
    return T.collateral_split(rows, ["fast_share", "s_slow", "s_fast"])


@query(
    "most_demoted_rows",
    "id:i demotion:f fast_share:f",
    _LONG + " select id, demotion, fast_share from demoted where form = 'ablated' order by demotion desc, id limit 20",
)
def most_demoted_rows(spark, sf_dir):
    """Top-k report: the twenty most demoted rows."""
    rows = _forms(Tables(spark, sf_dir)).where("form = 'ablated'")
    return N.top_rows(rows.select("id", "demotion", "fast_share"), 20, F.desc("demotion"), F.asc("id"))


@query(
    "disagreement_rows",
    "id:i label:s flagged:b",
    with_ctes("seeds", """(select id, label, flagged from seeds where label = 'low_credibility' and not flagged order by id limit 10)
      union all (select id, label, flagged from seeds where label = 'high_credibility' and flagged order by id limit 10)"""),
)
def disagreement_rows(spark, sf_dir):
    """Top-k report: the first ten disagreements of either kind."""
    s = Tables(spark, sf_dir).view("seeds").select("id", "label", "flagged")
    a = N.top_rows(s.where((F.col("label") == K.LOW) & ~F.col("flagged")), 10, F.asc("id"))
    b = N.top_rows(s.where((F.col("label") == K.HIGH) & F.col("flagged")), 10, F.asc("id"))
    return a.unionByName(b)


@query(
    "claim_split",
    "form:s n_flagged:i n_other:i mean_flagged:f mean_other:f diff:f u:f z_two_sided:f z_greater:f",
    _LONG + f""", r as (select form, flagged, demotion, {average_rank_sql('demotion', 'form')} as rk from demoted),
      ties as (select form, sum(c * c * c - c) as t from (select form, demotion, count(*)::double as c from demoted group by form, demotion) group by form),
      s as (select form, count(*) filter (flagged) as na, count(*) filter (not flagged) as nb, avg(demotion) filter (flagged) as ma,
        avg(demotion) filter (not flagged) as mb, sum(rk) filter (flagged) as ra from r group by form),
      u as (select *, ra - na::double * (na + 1) / 2 as u, sqrt(na::double * nb / 12 * (na + nb + 1 - t / ((na + nb)::double * (na + nb - 1)))) as sd from s join ties using (form))
      select form, na as n_flagged, nb as n_other, ma as mean_flagged, mb as mean_other, ma - mb as diff, u,
        (abs(u - na::double * nb / 2) - 0.5e0) / sd as z_two_sided, (u - na::double * nb / 2 - 0.5e0) / sd as z_greater from u""",
)
def claim_split(spark, sf_dir):
    return T.claim_split(_forms(Tables(spark, sf_dir)), "flagged")


@query(
    "claim_split_within_high",
    "form:s flagged:b n:i mean_demotion:f mean_gate:f",
    _LONG + """ select form, flagged, count(*) as n, avg(demotion) as mean_demotion, avg(gate) as mean_gate
      from demoted where label = 'high_credibility' group by form, flagged""",
)
def claim_split_within_high(spark, sf_dir):
    rows = _forms(Tables(spark, sf_dir)).where(F.col("label") == K.HIGH)
    return rows.groupBy("form", "flagged").agg(
        F.count(F.lit(1)).alias("n"), F.avg("demotion").alias("mean_demotion"), F.avg("gate").alias("mean_gate")
    )


@query(
    "score_gap_closure",
    "form:s gap:f gap_additive:f closure:f",
    with_ctes("wide", "").rstrip() + ", g as (" + " union all ".join(
        f"select '{n}' as form, (avg({c}) filter (label = 'low_credibility') - avg({c}) filter (label = 'high_credibility')) / greatest(avg({c}), 1e-12) as gap from wide"
        for n, c in {"additive": "score_additive", **_FORMS}.items()
    ) + ") select a.form, a.gap, b.gap as gap_additive, (b.gap - a.gap) / b.gap as closure from g a, g b where b.form = 'additive' and a.form <> 'additive'",
)
def score_gap_closure(spark, sf_dir):
    t = Tables(spark, sf_dir)
    base = mechanism_seeds(t).withColumn("score_complementary", S.Regime("c", "complementary").score())
    return T.score_gap_closure(base, "score_additive", {n: F.col(c) for n, c in _FORMS.items()})


_INPUTS = ("s_slow", "s_fast", "score_additive", "fast_share", "gate", "p_cred")


@query(
    "input_separability",
    "input:s n_a:i n_b:i mean_flagged:f mean_other:f diff:f u:f",
    with_ctes("wide", "").rstrip() + ", l as (select flagged, unnest(["
    + ", ".join(f"'{i}'" for i in _INPUTS) + "]) as input, unnest([" + ", ".join(_INPUTS).replace("gate", "round(gate, 9)") + f"""]) as v from wide)
      select input, count(*) filter (flagged) as n_a, count(*) filter (not flagged) as n_b, avg(v) filter (flagged) as mean_flagged,
        avg(v) filter (not flagged) as mean_other, avg(v) filter (flagged) - avg(v) filter (not flagged) as diff,
        sum(rk) filter (flagged) - (count(*) filter (flagged))::double * ((count(*) filter (flagged)) + 1) / 2 as u
      from (select *, {average_rank_sql('v', 'input')} as rk from l where v is not null) group by input""",
)
def input_separability(spark, sf_dir):
    m = mechanism_seeds(Tables(spark, sf_dir)).withColumn("gate", F.round("gate", 9))
    return M.input_separability(m, _INPUTS, "flagged")


# ---- two-sample on other tables ------------------------------------------

_TWO = """, ranked as (select metric, side, v, rank() over (partition by metric order by v) + (count(*) over (partition by metric, v) - 1) / 2e0 as rk,
    count(*) filter (side) over (partition by metric order by v) as ca, count(*) filter (not side) over (partition by metric order by v) as cb,
    count(*) filter (side) over (partition by metric) as na, count(*) filter (not side) over (partition by metric) as nb from samples),
  tested as (select metric, max(na) as n_a, max(nb) as n_b, avg(v) filter (side) as mean_a, avg(v) filter (not side) as mean_b,
    quantile_cont(v, 0.5) filter (side) as median_a, quantile_cont(v, 0.5) filter (not side) as median_b,
    quantile_cont(v, 0.9) filter (side) as p90_a, quantile_cont(v, 0.9) filter (not side) as p90_b,
    max(abs(ca / na - cb / nb)) as ks, sum(rk) filter (side) - max(na)::double * (max(na) + 1) / 2 as u from ranked group by metric)"""
_TWO_SPEC = "metric:s n_a:i n_b:i mean_a:f mean_b:f median_a:f median_b:f p90_a:f p90_b:f ks:f u:f auc:f"


@query(
    "two_sample_events",
    _TWO_SPEC,
    "with samples as (select 'value' as metric, event_type in ('click', 'purchase') as side, value as v from events)"
    + _TWO + " select *, u / (n_a::double * n_b) as auc from tested",
)
def two_sample_events(spark, sf_dir):
    """Kolmogorov-Smirnov and Mann-Whitney between two kinds of event."""
    e = Tables(spark, sf_dir).events.select(
        F.lit("value").alias("metric"), F.col("event_type").isin("click", "purchase").alias("side"), "value"
    )
    return M.two_sample(e, "value", "side", ["metric"])


@query("two_sample_events_p", "n_a:i n_b:i ks:f ks_p:f u:f mw_p:f mw_p_greater:f")
def two_sample_events_p(spark, sf_dir):
    e = Tables(spark, sf_dir).events.select(F.col("event_type").isin("click", "purchase").alias("side"), "value")
    return M.with_p_values(M.two_sample(e, "value", "side"))


@query(
    "ks_p_value",
    "n_a:i n_b:i ks:f ks_p:f",
    """select na as n_a, nb as n_b, ks, least(greatest(list_sum(list_transform(range(1, 101), lambda k: (case when k % 2 = 1 then 2e0 else -2e0 end)
        * exp(-2e0 * k * k * ks * ks * na * nb / (na + nb)))), 0e0), 1e0) as ks_p from (
      select max(na) as na, max(nb) as nb, max(abs(ca / na - cb / nb)) as ks from (
        select count(*) filter (side) over (order by v) as ca, count(*) filter (not side) over (order by v) as cb,
          count(*) filter (side) over () as na, count(*) filter (not side) over () as nb
        from (select l_returnflag = 'R' as side, l_extendedprice as v from lineitem)))""",
)
def ks_p_value(spark, sf_dir):
    rows = Tables(spark, sf_dir).lineitem.select((F.col("l_returnflag") == "R").alias("side"), "l_extendedprice")
    return M.with_p_values(M.two_sample(rows, "l_extendedprice", "side"))


_CLASSES = with_ctes("sums", "select score_additive as score, flagged as pos from sums")


@query(
    "roc_auc",
    "n_pos:i n_neg:i auc:f",
    f"""select np as n_pos, nn as n_neg, (r - np::double * (np + 1) / 2) / (np::double * nn) as auc from (
      select count(*) filter (pos) as np, count(*) filter (not pos) as nn, sum(rk) filter (pos) as r from
        (select pos, {average_rank_sql('score')} as rk from ({_CLASSES})))""",
)
def roc_auc(spark, sf_dir):
    return M.roc_auc(mechanism_seeds(Tables(spark, sf_dir)), "score_additive", "flagged")


_PR = f"""select threshold, tp, fp, tp / (tp + fp) as precision, tp / p as recall, fp / q as fpr, step / p as recall_step from (
  select score as threshold, sum(np) over (order by score desc) as tp, sum(nn) over (order by score desc) as fp,
    sum(np) over () as p, sum(nn) over () as q, np as step from
  (select score, (count(*) filter (pos))::double as np, (count(*) filter (not pos))::double as nn from ({_CLASSES}) group by score))"""


@query("pr_roc_curve", "threshold:f tp:i fp:i precision:f recall:f fpr:f", _PR)
def pr_roc_curve(spark, sf_dir):
    return M.threshold_curve(mechanism_seeds(Tables(spark, sf_dir)), "score_additive", "flagged")


@query("average_precision", "average_precision:f n_pos:i", f"select sum(recall_step * precision) as average_precision, max(tp) as n_pos from ({_PR})")
def average_precision(spark, sf_dir):
    return M.average_precision(mechanism_seeds(Tables(spark, sf_dir)), "score_additive", "flagged")


@query(
    "ecdf",
    "value:f share_at_or_below:f",
    "select distinct value, cume_dist() over (order by value) as share_at_or_below from events",
)
def ecdf(spark, sf_dir):
    return M.ecdf(Tables(spark, sf_dir).events.select("value"), "value")


@query(
    "histogram",
    "event_type:s bin:i left_edge:f n:i density:f",
    """select event_type, bin, lo + (hi - lo) / 45e0 * bin as left_edge, n, n / (sum(n) over (partition by event_type) * ((hi - lo) / 45e0)) as density from (
      select event_type, least(cast(floor((value - lo) / ((hi - lo) / 45e0)) as bigint), 44) as bin, count(*) as n, max(lo) as lo, max(hi) as hi
      from events, (select min(value) as lo, max(value) as hi from events) group by 1, 2)""",
)
def histogram(spark, sf_dir):
    return P.histogram(Tables(spark, sf_dir).events.select("event_type", "value"), "value", keys=["event_type"])


@query(
    "binned_means",
    "label:s bin:i center:f n:i mean_y:f",
    _LONG + """ select label, bin, lo + (hi - lo) / 12e0 * (bin + 0.5e0) as center, n, mean_y from (
      select label, cast(floor((fast_share - lo) / ((hi - lo) / 12e0)) as bigint) as bin, count(*) as n, avg(demotion) as mean_y, max(lo) as lo, max(hi) as hi
      from demoted, (select min(fast_share) as lo, max(fast_share) as hi from wide)
      where form = 'reflective_floor' and fast_share < hi and label is not null group by 1, 2) where n >= 5""",
)
def binned_means(spark, sf_dir):
    rows = stage(_forms(Tables(spark, sf_dir)).where("form = 'reflective_floor'").select("label", "fast_share", "demotion"), "demoted")
    return P.binned_means(rows, "fast_share", "demotion", ["label"]).where("label is not null")


@query(
    "kappa",
    "n:i agreement:f chance:f kappa:f",
    """with r as (select quality as a, toxic as b from labels where quality is not null and toxic is not null),
      t as (select count(*)::double as n, avg(case when a = b then 1e0 else 0e0 end) as po from r),
      e as (select sum(ca * cb) as s from (select a as c, count(*)::double as ca from r group by a) join (select b as c, count(*)::double as cb from r group by b) using (c))
      select n, po as agreement, s / (n * n) as chance, (po - s / (n * n)) / (1 - s / (n * n)) as kappa from t, e""",
)
def kappa(spark, sf_dir):
    return M.cohen_kappa(Tables(spark, sf_dir).labels, "quality", "toxic")


@query(
    "label_crosstab",
    "first:s second:s n:i",
    "select cast(quality as varchar) as first, cast(toxic as varchar) as second, count(*) as n from labels where quality is not null and toxic is not null group by 1, 2",
)
def label_crosstab(spark, sf_dir):
    return M.contingency(Tables(spark, sf_dir).labels, "quality", "toxic")


@query(
    "ratio_branch",
    "low_mean:f high_mean:f branch:s",
    with_ctes("seeds", """select l as low_mean, h as high_mean, case when l > h then 'higher' when abs(l - h) / greatest(h, 1e-9) < 0.05e0 then 'similar' else 'lower' end as branch
      from (select avg((p_retweet + p_like) / (p_reply + p_deep + 1e-3)) filter (label = 'low_credibility') as l,
        avg((p_retweet + p_like) / (p_reply + p_deep + 1e-3)) filter (label = 'high_credibility') as h from seeds)"""),
)
def ratio_branch(spark, sf_dir):
    """Three-way verdict on the class means of the predicted ratio."""
    ratio = S.reactive_ratio(1e-3)
    row = Tables(spark, sf_dir).view("seeds").agg(
        F.avg(F.when(F.col("label") == K.LOW, ratio)).alias("low_mean"),
        F.avg(F.when(F.col("label") == K.HIGH, ratio)).alias("high_mean"),
    )
    return row.withColumn("branch", T.ratio_branch(F.col("low_mean"), F.col("high_mean")))


_FRONT = with_ctes("wide", "").rstrip() + """, gs as (select *, 1e0 / (1e0 + exp(-((p_cred - med) / sd))) as g from wide,
    (select quantile_cont(p_cred, 0.5) as med, stddev_pop(p_cred) as sd from wide)),
  gates as (""" + " union all ".join(
    [f"select id, label, flagged, fast_share, score_additive, 'tempered_{x:g}' as form, score_reflective_floor * pow(g, {x!r}::double) as form_score from gs" for x in K.TEMPER_GRID]
    + [
        f"select id, label, flagged, fast_share, score_additive, 'tail_{q:g}', score_reflective_floor * least(1e0, g / t) from gs, (select quantile_cont(g, {q!r}) as t from gs)"
        for q in K.TAIL_GRID
    ]
) + f"""), ranked as (select *, {percent_rank_sql('score_additive', 'form')} - {percent_rank_sql('form_score', 'form')} as demotion from gates),
  known as (select *, {average_rank_sql('fast_share', 'form')} as rs, {average_rank_sql('demotion', 'form')} as rd from ranked where fast_share is not null),
  cuts as (select form, quantile_cont(demotion, 0.75) as q75, quantile_cont(fast_share, 0.1) as d10, quantile_cont(fast_share, 0.9) as d90 from known group by form)"""


_CELL_ROWS = 4_000_000


@query(
    "frontier",
    "form:s rho:f top_quarter_low_share:f demotion_top_tenth:f demotion_bottom_tenth:f claim_diff:f",
    _FRONT + """ select form, corr(rs, rd) as rho,
      avg(case when label = 'low_credibility' then 1e0 else 0e0 end) filter (demotion >= q75) as top_quarter_low_share,
      avg(demotion) filter (fast_share >= d90) as demotion_top_tenth, avg(demotion) filter (fast_share <= d10) as demotion_bottom_tenth,
      avg(demotion) filter (flagged) - avg(demotion) filter (not flagged) as claim_diff
      from known join cuts using (form) group by form""",
)
def frontier(spark, sf_dir):
    """Every gate cell: targeting on all seeds and the claim split.

    A cell ranks all seeds anew. As many cells share a pass as make ``_CELL_ROWS`` rows; then
    their tables are removed, so that the disk holds those of one pass.
    """
    read = mechanism_seeds(Tables(spark, sf_dir)).select("label", "flagged", "fast_share", "p_cred", "score_additive", "score_reflective_floor")
    ranked = stage(N.attach_ranks(read, {"fast_share": "share_rank"}), "share-ranks")
    ranked = stage(N.attach_ranks(ranked, {"score_additive": "rank_additive"}, "percent"), "additive-ranks")
    gated = T.tail_gates(T.quality_gate(ranked, "p_cred"), "gate_quality")
    floor = F.col("score_reflective_floor")
    forms = {f"tempered_{x:g}": floor * T.tempered("gate_quality", x) for x in K.TEMPER_GRID}
    forms |= {f"tail_{q:g}": floor * F.col(f"tail_{round(100 * q)}") for q in K.TAIL_GRID}
    names, per = list(forms), max(1, _CELL_ROWS // max(1, ranked.count()))
    found = []
    for lo in range(0, len(names), per):
        with passing(spark):
            some = {name: forms[name] for name in names[lo : lo + per]}
            long = stage(T.demotion_long(gated, "score_additive", some, ["label", "flagged", "fast_share", "share_rank"]), "cells")
            claims = T.mean_differences(long, "flagged").select("form", F.col("diff").alias("claim_diff"))
            made = T.targeting_metrics(long, rank="share_rank").join(claims, "form")
            found += made.collect()  # a row a form
    return spark.createDataFrame(found, made.schema)


@query(
    "label_summary",
    "label:s metric:s count:i mean:f std:f p10:f p50:f p90:f p99:f",
    with_ctes("wide", """select label, metric, count(*) as count, avg(v) as mean, stddev_samp(v) as std, quantile_cont(v, 0.1) as p10, quantile_cont(v, 0.5) as p50,
      quantile_cont(v, 0.9) as p90, quantile_cont(v, 0.99) as p99 from (
        select label, unnest(['p_reply', 'p_retweet', 'gate', 'score_ablated']) as metric, unnest([p_reply, p_retweet, gate, score_ablated]) as v
        from wide where label in ('low_credibility', 'high_credibility')) group by label, metric"""),
)
def label_summary(spark, sf_dir):
    m = mechanism_seeds(Tables(spark, sf_dir)).where(F.col("label").isin(K.LOW, K.HIGH))
    probes = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}
    return P.numeric_profile(m, ["p_reply", "p_retweet", "gate", "score_ablated"], probes, ["label"])


@query(
    "diagnostic_export",
    "id:i label:s followers:i p_reply:f p_deep:f pred_ratio:f observed_engagement:i score_additive:f score_ablated:f rank_additive:f disp_ablated:f",
    with_ctes("wide", f"""select id, label, followers, p_reply, p_deep, (p_retweet + p_like) / (p_reply + p_deep + 1e-3) as pred_ratio, observed_engagement,
      score_additive, score_ablated, {average_rank_sql('score_additive')} / count(*) over () as rank_additive,
      {average_rank_sql('score_ablated')} / count(*) over () - {average_rank_sql('score_additive')} / count(*) over () as disp_ablated from wide"""),
)
def diagnostic_export(spark, sf_dir):
    """One row per seed with inputs, scores, ranks and displacement."""
    m = mechanism_seeds(Tables(spark, sf_dir)).withColumn("pred_ratio", S.reactive_ratio(1e-3))
    return T.displacement(m, "score_additive", ["score_ablated"]).withColumnsRenamed(
        {"rank_score_additive": "rank_additive", "disp_score_ablated": "disp_ablated"}
    )


@query(
    "claim_breakdown",
    "label:s n:i flagged_share:f",
    with_ctes("seeds", "select label, count(*) as n, avg(case when flagged then 1e0 else 0e0 end) as flagged_share from seeds where label is not null group by label"),
)
def claim_breakdown(spark, sf_dir):
    s = Tables(spark, sf_dir).view("seeds").where("label is not null")
    return s.groupBy("label").agg(F.count(F.lit(1)).alias("n"), share(F.col("flagged")).alias("flagged_share"))
