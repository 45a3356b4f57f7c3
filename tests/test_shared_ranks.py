"""Ranks that all forms share are made once, with the results of ranks per form."""

import pandas as pd
import pytest

from tidemark.operators import targeting as T
from tidemark.operators.ranks import attach_ranks


def rows(spark, unknown):
    base = [(i, float(i * 37 % 50) if i % 9 else None, i % 4 == 0, "low_credibility" if i % 3 else None) for i in range(200)]
    df = attach_ranks(spark.createDataFrame(base, "id long, fast_share double, flagged boolean, label string"), {"fast_share": "share_rank"})
    pdf = df.toPandas()
    long = pd.concat([pdf.assign(form=f, demotion=[float((i * k) % 41) - 20 for i in pdf["id"]]) for f, k in (("a", 7), ("b", 11))])
    if unknown:
        long.loc[(long["form"] == "b") & (long["id"] == 10), "demotion"] = None
    long = long.astype({"fast_share": object, "share_rank": object, "demotion": object}).where(long.notna(), None)
    return spark.createDataFrame(long[["form", "id", "fast_share", "share_rank", "flagged", "label", "demotion"]].values.tolist(),
                                 "form string, id long, fast_share double, share_rank double, flagged boolean, label string, demotion double")


@pytest.mark.parametrize("unknown", [False, True])
def test_one_rank_for_all_forms(spark, monkeypatch, unknown):
    long = rows(spark, unknown)
    want = {r["form"]: r.asDict() for r in T.targeting_metrics(long).collect()}
    ranked = []
    whole = T.attach_ranks
    monkeypatch.setattr(T, "attach_ranks", lambda *a, **k: (ranked.append(a), whole(*a, **k))[1])
    got = {r["form"]: r.asDict() for r in T.targeting_metrics(long, rank="share_rank").collect()}
    assert len(ranked) == unknown and got.keys() == want.keys()
    assert all(got[f][c] == pytest.approx(want[f][c]) for f in want for c in want[f] if c != "form")
    means = {r["form"]: r["diff"] for r in T.mean_differences(long, "flagged").collect()}
    tested = {r["form"]: r["diff"] for r in T.claim_split(long, "flagged").collect()}
    assert means == pytest.approx(tested)
