"""Benchmark: run every catalog query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value" (sum of query seconds), "unit",
"queries": {name: seconds}, "sf"}. Each query is executed in full through
the ``noop`` sink (no driver collect), up to three times as long as it stays
under two seconds; the median counts, and ``spread`` is the range. Set BENCH_QUERIES=a,b to run a subset
and BENCH_EVENT_LOG=1 to write Spark's event log to a scratch folder.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


REPEATS, REPEAT_SECONDS = 3, 2.0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from pyspark.sql import SparkSession

    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fleetlake-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", os.environ.get("BENCH_SHUFFLE", str(max(8, int(cpus) * 2))))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
    )
    if os.environ.get("BENCH_EVENT_LOG"):
        log_dir = tempfile.mkdtemp(prefix="fleetlake-events-")
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    from fleetlake.plans.catalog import queries
    from fleetlake.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    qs = queries()
    names = [n for n in qs if not only or n in only]

    # warm-up: JVM, codegen caches and the parquet footers (not timed)
    try:
        qs["customer_health"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    except Exception:  # noqa: BLE001 - the timed run reports failures per query
        pass

    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    spread: dict[str, float] = {}
    for name in names:
        runs: list[float] = []
        try:
            # short queries are repeated, so that their figure is not one pause of the machine
            while len(runs) < REPEATS and sum(runs) < REPEAT_SECONDS:
                t0 = time.perf_counter()
                qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - t0)
        except Exception as e:  # noqa: BLE001 - report and keep measuring the rest
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
            continue
        times[name] = round(median(runs), 3)
        spread[name] = round(max(runs) - min(runs), 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "spread": spread,
                "sf": float(m.group(1)) if m else sf_dir,
                **({"failed": failed} if failed else {}),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
