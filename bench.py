"""Headline timings: scan, drift and clean-and-rescan, on one local session.

Prints one JSON line. Each figure is the median of three runs after one warm-up run."""

from __future__ import annotations

import json
import os
import statistics
import time

from datavitals import DriftReport, Scan, get_session
from datavitals.operators.cleaning import compare_scans, simulate_cleaning
from datavitals.operators.scoring import health_score
from suite import sources as S


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
        spark__python__sql__dataFrameDebugging__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def scan(source) -> int:
        s = Scan(source.frame(spark, sf_dir), source.roles)
        return health_score(s.issues).first()["health_score"]

    def drift(before, after) -> int:
        return DriftReport(before.frame(spark, sf_dir), after.frame(spark, sf_dir)).summary.first()["drift_score"]

    def clean() -> int:
        before = Scan(S.EVENTS_SHORT.frame(spark, sf_dir))
        after = Scan(simulate_cleaning(before.df, before=before).df)
        return compare_scans(before, after).first()["improvement"]

    jobs = {
        "scan_lineitem": lambda: scan(S.LINEITEM),
        "scan_documents": lambda: scan(S.DOCUMENTS),
        "scan_events_dirty": lambda: scan(S.EVENTS_ROLES),
        "drift_lineitem": lambda: drift(S.ITEMS_BEFORE, S.ITEMS_AFTER),
        "drift_events": lambda: drift(S.EVENTS_BEFORE, S.EVENTS_AFTER),
        "clean_events": clean,
    }
    queries = {}
    for name, job in jobs.items():
        job()
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            job()
            times.append(time.perf_counter() - start)
        queries[name] = round(statistics.median(times), 3)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(json.dumps({
        "metric": "total_warm_median", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
        "rows_per_sec": {"scan_lineitem": round(rows / queries["scan_lineitem"]), "drift_lineitem": round(rows / queries["drift_lineitem"])},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
