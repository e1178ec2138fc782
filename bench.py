"""Headline jobs, timed one after the other; prints one JSON line.

Reads ``$BENCH_SF_DIR`` and runs on ``local[$BENCH_CPUS]``. Every job is run in full (its rows are
written to a sink that drops them); the first run of a small job warms the session and is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from veilwork.catalog import QUERIES  # noqa: E402
from veilwork.plans import clear_stages  # noqa: E402

HEADLINE = [
    "detect_email",
    "detect_apikey",
    "scan_documents",
    "scan_totals",
    "register_documents",
    "dictionary_match",
    "anonymize_documents",
    "leak_audit_documents",
    "restore_log",
    "round_trip_audit",
    "register_log",
    "anonymize_log",
    "link_entities",
    "column_aware_table",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("veilwork-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="veilwork-bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    wanted = sys.argv[1:] or HEADLINE
    run("detect_email")
    times = {name: run(name) for name in wanted}
    clear_stages(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline jobs",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
