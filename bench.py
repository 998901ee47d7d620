"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local cores. Every
query is written to the no-op sink, so all of its rows are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.plans.registered import QUERIES  # noqa: E402
from millrace.session import local_session  # noqa: E402

HEADLINE = [
    "validation_suite",
    "quality_score",
    "duplicate_rows_check",
    "fk_orphan_check",
    "profile_column",
    "join_confidence",
    "leakage_scan",
    "feature_advice",
    "approval_manifest",
    "drop_duplicates",
    "impute",
    "standardize_timestamp",
    "fk_repair",
    "remove_outliers",
    "label_encode",
    "clean_tables",
    "cell_diff",
    "enrich_join",
    "temporal_features",
    "geo_features",
    "operational_features",
    "business_features",
    "train_test_split",
    "one_hot",
    "ordinal_encode",
    "standard_scale",
    "correlated_columns",
    "registry_state",
    "activity_feed",
    "regression_metrics",
    "leaderboard",
    "monitor_batch",
    "drift_scan",
    "rank_impacts",
    "explain_text",
    "describe_stats",
    "histogram",
    "box_summary_by",
    "group_mean",
    "insight_table",
    "intent_tags_documents",
    "train_regressor",
    "batch_score",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, "millrace-bench", os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["row_count"](spark, folder).collect()  # start the engine
    seconds: dict[str, float] = {}
    for name in HEADLINE if len(sys.argv) < 2 else sys.argv[1:]:
        begun = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
    result = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
