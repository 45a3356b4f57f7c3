"""The seed, reach and panel tables the registered queries start from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.scoring import Regime, all_regimes, mechanism, score_long
from tidemark.operators.profiles import diurnal_weights
from tidemark.operators.reach import hourly_plan, with_reach
from tidemark.plans.views import N_REPLICATES, PANEL_REGIMES, Tables
from tidemark.session import stage


def seeds(t: Tables) -> DataFrame:
    """Seeds written once, evenly spread: every later pass reads columns of this table."""
    return stage(t.view("seeds"), "seeds", "id")


def mechanism_seeds(t: Tables) -> DataFrame:
    return stage(mechanism(t.view("seeds")), "mechanism", "id")


def regimes(names: Sequence[str]) -> list[Regime]:
    known = {r.name: r for r in all_regimes()}
    return [known[n] for n in names]


def _count(propensity: str, a: int, b: int) -> Column:
    wobble = ((F.col("cascade_id") * a + F.col("replicate") * b) % 11 - 5) / F.lit(50.0)
    return F.floor(F.col("total_exposures") * F.col(propensity) * (F.lit(1.0) + wobble)).cast("double")


def panel(t: Tables, keep: Sequence[str] = ()) -> DataFrame:
    """A deterministic cascade panel: expected events with a small id-driven wobble. ``keep``: more columns of the seeds."""
    long = score_long(seeds(t), regimes(PANEL_REGIMES), ["id", "label", *keep, *[f"p_{h}" for h in K.HEADS]])
    reach = with_reach(long)
    rows = reach.select(
        "regime", F.col("id").alias("cascade_id"), "label", *keep, F.col("reach").alias("total_exposures"),
        *[f"p_{h}" for h in K.HEADS], F.explode(F.sequence(F.lit(0), F.lit(N_REPLICATES - 1))).alias("replicate"),
    )
    return rows.select(
        "regime", "replicate", "cascade_id", "label", *keep, "total_exposures",
        _count("p_reply", 7, 13).alias("n_reply"),
        _count("p_retweet", 5, 17).alias("n_retweet"),
        _count("p_like", 3, 19).alias("n_like"),
        _count("p_deep", 11, 23).alias("n_deep"),
    )


#: Each seed's share of exposure in each of the 24 hours after it; a fixed number of decimals, so that floors agree.
PLAN_SHARES_SQL = """clock as (select cast(floor(epoch / 36e2) as bigint) % 24 as hour, count(*) as n from posts group by 1),
    weights as (select h as hour, coalesce(n, 0) * (24e0 / sum(n) over ()) as weight from range(24) as r(h) left join clock on h = hour),
    shape as (select s.id, b.t as t_hour, exp(-b.t / 6e0) * w.weight as part from seeds s, range(24) as b(t)
      join weights w on w.hour = (cast(floor(s.epoch / 36e2) as bigint) + b.t) % 24),
    shares as (select id, t_hour, round(part / sum(part) over (partition by id) + 3e-13, 9) as share from shape)"""


def plan_shares(t: Tables) -> DataFrame:
    """``(cascade_id, t_hour, share)``: the hourly plan of one unit of exposure."""
    rows = t.view("seeds").select(F.col("id").alias("cascade_id"), "epoch", F.lit(1.0).alias("reach"))
    plan = hourly_plan(rows, diurnal_weights(t.view("posts")), keep=["cascade_id"])
    return plan.select("cascade_id", "t_hour", F.round(F.col("planned") + F.lit(3e-13), 9).alias("share"))


def shares_from(t: Tables, epoch: Column) -> Column:
    """The shares of ``plan_shares`` as an array over hours, without a join: they depend on the hour of the day alone."""
    starts = t.spark.range(24).select(F.col("id").alias("start"), (F.col("id") * 3600.0).alias("epoch"), F.lit(1.0).alias("reach"))
    plan = hourly_plan(starts, diurnal_weights(t.view("posts")), keep=["start"])
    cells = plan.select("start", "t_hour", F.round(F.col("planned") + F.lit(3e-13), 9).alias("share"))
    each = cells.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("t_hour", "share"))).alias("c"))
    by_start = each.agg(F.array_sort(F.collect_list(F.struct("start", F.col("c.share").alias("shares"))))["shares"]).scalar()
    start = F.pmod(F.floor(epoch / F.lit(3600.0)), F.lit(24)).cast("int")
    return F.element_at(by_start, start + 1)


def hourly_panel(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """Replies of each cascade dealt over hours by the exposure plan, whole ones counted."""
    hours = rows.select("regime", "replicate", "cascade_id", "n_reply").join(shares, "cascade_id")
    return hours.select("regime", "replicate", "cascade_id", "t_hour", F.floor(F.col("n_reply") * F.col("share")).alias("n_reply"))
