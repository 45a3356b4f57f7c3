"""Joins with small tables of figures: the rows stay where they are."""

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions import scoring as S
from tidemark.operators import reach as R
from tidemark.operators.ranks import join_figures


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def seeds(spark):
    label = F.when(F.col("id") % 3 == 0, K.LOW).when(F.col("id") % 3 == 1, K.HIGH)
    props = [(F.pmod(F.xxhash64("id", F.lit(h)), F.lit(1000)) / 1000.0).alias(f"p_{h}") for h in K.HEADS]
    return spark.range(3000).select("id", label.alias("label"), *props)


def test_reach_neither_shuffles_nor_broadcasts_the_scored_rows(spark):
    long = S.score_long(seeds(spark), S.all_regimes(), ["id", "label"])
    reach = R.with_reach(long)
    text = plan(reach)
    assert "SortMergeJoin" not in text and "ShuffledHashJoin" not in text
    broadcast = text[text.index("BroadcastExchange"):]
    assert "Generate" not in broadcast and "Range" not in broadcast
    medians = {r["regime"]: r["m"] for r in long.groupBy("regime").agg(F.percentile("score", F.lit(0.5)).alias("m")).collect()}
    for r in reach.where("id < 20").collect():
        assert abs(r["rel_score"] - r["score"] / medians[r["regime"]]) < 1e-12
    assert reach.count() == 3000 * len(medians)


def test_many_figures_are_not_broadcast(spark):
    figures = spark.range(1500).select("id", (F.col("id") * 2).alias("twice"))
    joined = join_figures(spark.range(3000), figures, ["id"])
    assert joined.count() == 1500 and joined.where("twice <> 2 * id").count() == 0
    assert "rightHint=(strategy=broadcast)" not in joined._jdf.queryExecution().optimizedPlan().toString()
