"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import all_queries  # noqa: E402
from tamperlens.plans.staging import clear_staged  # noqa: E402
from tamperlens.session import build_session  # noqa: E402

HEADLINE = [
    "row_ids",
    "terminal_digits",
    "duplicate_ids",
    "out_of_sequence_dense",
    "sorting_anomalies",
    "distribution_stats_overall",
    "multimodality",
    "inlier_bands_overall",
    "compare_with_without",
    "suspicious_effects",
    "chain_anomalies",
    "column_profile",
    "segment_describe",
    "context_rows",
    "row_issues",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog = all_queries()
    # one warm-up query so that class loading is not charged to the first one
    catalog["head_sample"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        catalog[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        clear_staged(spark)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
