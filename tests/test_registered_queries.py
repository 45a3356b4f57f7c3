import pytest

from tidemark.plans import load
from tidemark.plans.check import compare, connect

SF = "/root/testdata/sf0.001"
QUICK = (
    "flagship_gap_contrast", "regime_scores_all", "content_gates", "placebo_params", "percentile_ranks", "class_comparison",
    "two_sample_events", "average_precision", "kappa", "numeric_profile", "time_to_peak_observed", "calibration", "tree_stats",
    "domain_labels", "emotion_labels", "features", "bins_four_modes", "replicate_gaps", "bootstrap_gap", "matched_controls",
    "user_sample", "ingest_parse", "stream_hourly", "spliced_results",
)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_oracle(spark, con, name):
    assert compare(spark, con, SF, name, load()[name]).startswith("OK")


def test_every_query_has_a_plain_name_and_spec():
    for name, q in load().items():
        assert name.islower() and q.spec and len({n for n, _ in q.spec}) == len(q.spec)
