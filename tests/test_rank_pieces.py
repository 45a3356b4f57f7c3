"""Rank agreement of more rows than one piece holds, without a shuffle of rows times vectors."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import weightgrid as W


def test_pieces_give_the_same_and_are_not_shuffled(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(np.round(rng.random((700, 4)), 1), columns=["p_reply", "p_retweet", "p_like", "p_deep"])
    df = spark.createDataFrame(pd.concat([pdf, pdf[:90]]))
    vectors = [*W.named_weights().values(), *W.weight_grid()[::300], dict.fromkeys(("reply", "retweet", "like", "deep"), 0.0)]
    whole = {r["v"]: r["rho"] for r in W.rank_agreement(df, vectors).collect()}
    monkeypatch.setattr(W, "fits_one_task", lambda df: False)
    monkeypatch.setattr(W, "_PIECE", 100)
    with monkeypatch.context() as m:
        m.setattr(W, "_shuffled_agreement", lambda *a: pytest.fail("rows times vectors are shuffled"))
        pieces = {r["v"]: r["rho"] for r in W.rank_agreement(df, vectors).collect()}
    monkeypatch.setattr(W, "_SENT_ROWS", 10)
    shuffled = {r["v"]: r["rho"] for r in W.rank_agreement(df, vectors).collect()}
    assert len(whole) == len(vectors) and whole[len(vectors) - 1] is None
    assert pieces == pytest.approx(whole, abs=1e-12) and shuffled == pytest.approx(whole, abs=1e-9)
