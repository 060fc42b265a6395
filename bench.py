"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark import session  # noqa: E402

HEADLINE = [
    "price_scan", "macd", "adx", "technical_frame", "rule_signals", "explanation_audit", "backtest_summary",
    "walk_forward_folds", "fundamentals_tidy", "rebalance_calendar", "feature_matrix", "rank_normalised",
    "sector_zscore_normalised", "labels_median", "momentum_book", "ranking_metrics", "information_summary",
    "long_short", "permutation_test", "block_bootstrap", "sensitivity_grid", "random_null_summary", "direction_panel",
    "prediction_summary", "prediction_auc", "selective_accuracy", "sentiment_feature", "newest_headlines",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build("bench", f"local[{cpus}]", **{
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # no call sites per expression
        # A few megabytes per task is right on a cluster, but would leave local cores idle.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    })
    spark.sparkContext.setLogLevel("OFF")
    from tidemark.plans.catalog import REGISTRY
    names = sys.argv[1:] or HEADLINE
    REGISTRY["history_status"](spark, sf_dir).collect()  # start the JVM's and Python's workers
    seconds = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
