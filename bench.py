"""Time the headline queries and print one JSON line.

Settings: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_QUERIES (names).
"""

from __future__ import annotations

import json
import os
import sys
import time

from tidemark.plans import load
from tidemark.session import build_session

HEADLINE = (
    "flagship_gap_contrast", "regime_scores_all", "seed_reach", "reach_table", "operating_curve", "hourly_plan",
    "weight_grid", "content_gates", "placebo_params", "demotion", "targeting_metrics", "ratio_level",
    "most_demoted_decile", "claim_split", "two_sample_events", "roc_auc", "pr_roc_curve", "kappa", "numeric_profile",
    "conversation_sizes", "calibration", "distribution_records", "tree_stats", "domain_labels", "emotion_labels",
    "features", "scaled_features", "user_sample", "matched_controls", "replicate_contrasts", "bootstrap_contrast",
    "subgroup_contrasts", "tfidf_documents", "ingest_parse", "stream_hourly", "propensity_fit",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session(
        f"local[{cpus}]", "tidemark-bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = load()
    took: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        registered[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
                "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()
