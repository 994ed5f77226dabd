"""Headline queries on local[$BENCH_CPUS]: one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import QUERIES  # noqa: E402
from gleanframe.session import local_session  # noqa: E402

HEADLINES = (
    "numeric_metrics_lineitem", "categorical_metrics_orders", "datetime_metrics_orders", "structure_lineitem",
    "distinct_counts_lineitem", "duplicate_texts", "quality_summary_lineitem", "pearson_lineitem",
    "cramers_v_lineitem", "correlation_ratio_lineitem", "spearman_quantity_price", "kruskal_flag_price",
    "outliers_lineitem", "concentration_values_part", "group_profiles_orders", "join_links", "verify_join_lineitem",
    "chart_histograms_lineitem", "chart_series_events", "trend_halves_orders",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus)
    times: dict[str, float] = {}
    for name in HEADLINES:
        seen = []
        for _ in range(runs + 1):                    # the first run warms up
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seen.append(time.perf_counter() - start)
        times[name] = round(statistics.median(seen[1:]), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))


if __name__ == "__main__":
    main()
