"""Stage 2: the panel is summed where it is made; gaps and contrasts share one pass of draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.operators import contrasts as C


def panel(spark):
    label = F.element_at(F.array(F.lit(K.LOW), F.lit(K.HIGH), F.lit("mixed")), (F.col("id") % 3 + 1).cast("int"))
    rows = spark.range(90).select(F.col("id").alias("cascade_id"), label.alias("label"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("replicate"))
    rows = rows.select("*", F.explode(F.array(F.lit("additive"), F.lit("ablated"))).alias("regime"))
    x = (F.col("cascade_id") * 7 + F.col("replicate") * 3 + F.length("regime")) % 13
    return rows.withColumn("x", x.cast("double")).withColumn("y", F.col("x") * F.col("x"))


def test_no_panel_row_is_written_and_draws_are_made_once(spark, monkeypatch):
    written, drawn = [], []
    stage, sums = C.stage, C.bootstrap_sums
    monkeypatch.setattr(C, "stage", lambda df, name, *a: written.append((name, out := stage(df, name, *a))) or out)
    monkeypatch.setattr(C, "bootstrap_sums", lambda *a, **b: drawn.append(1) or sums(*a, **b))
    rows, metrics = panel(spark), {"x": F.col("x"), "y": F.col("y")}
    got = {(r["kind"], r["metric"], r["regime"]): r for r in C.stage2(rows, metrics, ["additive", "ablated"], 40).collect()}
    assert len(drawn) == 1 and len(got) == 2 * (2 + 1 + 2 + 1)
    assert max(out.count() for _, out in written) <= 90
    pdf = rows.toPandas()
    for m in metrics:
        means = pdf.groupby(["regime", "replicate", "label"])[m].mean()
        gap = {r: (means[r].unstack()[K.LOW] - means[r].unstack()[K.HIGH]).to_numpy() for r in ("additive", "ablated")}
        wide = C.replicate_means(rows, metrics, ["additive", "ablated"])
        one = C.bootstrap_contrasts(wide, {"c": (f"{m}__additive", f"{m}__ablated")}, 40).first()
        of = C.bootstrap_gaps(wide, [f"{m}__ablated"], 40).first()
        diff = gap["ablated"] - gap["additive"]
        for kind, point, lo, hi in (
            ("gap", gap["ablated"].mean(), *np.percentile(gap["ablated"], [2.5, 97.5])), ("contrast", diff.mean(), *np.percentile(diff, [2.5, 97.5])),
            ("boot_gap", of["point"], of["ci_lo"], of["ci_hi"]), ("boot_contrast", one["point"], one["ci_lo"], one["ci_hi"]),
        ):
            r = got[kind, m, "ablated"]
            assert [r["point"], r["ci_lo"], r["ci_hi"]] == pytest.approx([point, lo, hi], abs=1e-12) and r["n_low"] == r["n_high"] == 30
