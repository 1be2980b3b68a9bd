"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ..., "rows_per_sec": {...}}

Each query is materialised completely with the ``noop`` sink (no collect),
after one warm-up run of the flagship query to load the JVM code paths.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "feature_pipeline",     # flagship: the batched feature table
    "join_frequency",       # fit aggregate + lookup join
    "cum_unique",           # segmented running distinct count
    "time_since_previous",  # segmented running 'last before'
    "corpus_statistics",    # 36 distinct counts in one grouped pass
    "value_risk_topk",      # per-value risk, top-k folding
    "metrics_by_slice",     # ROC / PR areas and curve per slice
    "pr_auc_interpolated",  # Davis-Goadrich area
    "word_risk",            # bag-of-words statistics
    "bad_word_ratio",       # per-row bad-word share
    "session_statistics",   # session sizes
    "describe_all",         # per-column statistics with exact quartiles
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from editrisk.plans import registry
    from editrisk.session import build_session
    from editrisk.sources.tables import read

    spark = build_session(f"local[{cpus}]", int(cpus) * 2)
    registry.load_all()
    events = read(spark, sf_dir, "events").count()

    def run(name: str) -> float:
        t0 = time.time()
        df = registry.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        dt = time.time() - t0
        spark.catalog.clearCache()
        return dt

    run("feature_pipeline")  # warm-up: JIT and code generation
    run("metrics_by_slice")
    times = {}
    for name in HEADLINE:
        times[name] = round(run(name), 3)
    total = round(sum(times.values()), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_sec",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "rows_per_sec": {k: round(events / v, 1) for k, v in times.items() if v > 0},
        "log_rows": events,
        "cpus": int(cpus),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
