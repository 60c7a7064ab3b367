"""Time the registered queries; prints one JSON line.

BENCH_SF_DIR   tables to read (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names (default all)
BENCH_RUNS     timed runs per query after one warm-up run; the best counts (default 2)
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from rollcall import build_session  # noqa: E402
from rollcall.plans.catalog import queries  # noqa: E402


def run(query, spark, folder) -> float:
    """Seconds to compute every row; the noop sink takes them without writing."""
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - start
    spark.catalog.clearCache()
    return seconds


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    every = queries()
    names = os.environ.get("BENCH_QUERIES")
    chosen = names.split(",") if names else list(every)
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        extra={
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in chosen:
        times = [run(every[name], spark, folder) for _ in range(runs + 1)]
        seconds[name] = round(min(times[1:] or times), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds over all queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
