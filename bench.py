"""Benchmark: run the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_QUERIES (comma list, default: the headline set).
Each query is executed in full through the ``noop`` sink (no collect to the
driver); the reported time per query is wall-clock seconds.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fraudlens.plans import HEADLINE, QUERIES  # noqa: E402
from fraudlens.session import get_spark  # noqa: E402

DEFAULT_SET = HEADLINE + ["clean_columns", "merchant_velocity", "uid_velocity", "target_encoding",
                          "edge_table", "risk_heatmap", "daily_trend", "label_correlations",
                          "roc_auc", "threshold_sweep", "evaluation", "rule_scoring",
                          "bipartite_edges", "node_index", "connected_components",
                          "neighbour_mean", "propagation"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or \
        list(dict.fromkeys(n for n in DEFAULT_SET if n in QUERIES))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(cpus * 2, 8))
    # Warm-up: JVM, parquet footer cache.
    spark.read.parquet(f"{sf_dir}/events.parquet").write.format("noop").mode("overwrite").save()
    times, errors = {}, {}
    for name in names:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001 - report and keep benchmarking the rest
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else None, "cpus": cpus}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
