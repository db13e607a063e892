"""Benchmark of the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line.  Every query is executed
to completion with the ``noop`` sink (no driver collect), after the
one-time landing of the case tables (reported as ``ingest``) and one
untimed warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "metrics_bundle",
    "case_increase_rate",
    "mortality_rate",
    "icu_rate",
    "vaccination_rate",
    "rates_by_state",
    "src_csv_scan",
    "load_window",
    "moving_average_7d",
    "monthly_counts",
    "data_summary",
    "dedupe_cases",
    "duplicate_counts",
    "quality_report",
    "anonymise_cases",
    "redact_text",
    "article_flow",
    "context_score",
    "article_rank",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from epispark.session import local_session
    from epispark.plans.catalog import QUERIES

    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="epispark-bench")
    keys = [k for k in (sys.argv[1:] or HEADLINE) if k in QUERIES]

    def run(key: str) -> float:
        t0 = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    from epispark.plans.catalog import fixture_csv
    from epispark.sources import fixtures as FX

    # One-time landing of the case tables (raw strings, typed + partitioned, daily rollup, quality state)
    # and of the CSV form used by the scan queries; reported on its own.
    t0 = time.perf_counter()
    FX.cases(spark, sf_dir)
    FX.rollup(spark, sf_dir)
    FX.quality_state(spark, sf_dir)
    fixture_csv(spark, sf_dir)
    ingest = time.perf_counter() - t0
    run("date_span")  # warm-up: JVM, codegen, file listing
    times = {"ingest": round(ingest, 3)}
    times.update({k: round(run(k), 3) for k in keys})
    if not sys.argv[1:]:
        # Baseline counterpart: five mortality runs at once on one session.
        from concurrent.futures import ThreadPoolExecutor

        t0 = time.perf_counter()
        with ThreadPoolExecutor(5) as pool:
            list(pool.map(lambda _: run("mortality_rate"), range(5)))
        times["mortality_rate_x5_concurrent"] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        sf_val: float | str = float(sf)
    except ValueError:
        sf_val = sf
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_val, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
