"""Wall time of the registered queries on one machine, as one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores, BENCH_QUERIES (comma
separated) a choice of queries, BENCH_RUNS the timed runs of each, of which the
fastest counts; `cold` has the first. Every result is computed whole, into Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pelagrid import build_session  # noqa: E402
from pelagrid.plans.catalogue import QUERIES  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    spark = build_session(
        "pelagrid-bench", f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_linenumber").count().collect()
    seconds, cold = {}, {}
    for name in names:
        took = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name], cold[name] = round(min(took), 4), round(took[0], 4)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of the registered queries",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "cold": cold,
        "sf": Path(folder).name,
    }))


if __name__ == "__main__":
    main()
