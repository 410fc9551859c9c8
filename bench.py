"""Times every named query and prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local threads), BENCH_QUERIES
(comma-separated names, all by default).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from floodsift.plans.catalog import QUERIES
from floodsift.session import RECOMMENDED


def shuffle_bytes(spark: SparkSession) -> int:
    """Bytes written to shuffles so far, from the session's own stage records."""
    context = spark.sparkContext
    quantiles = context._gateway.new_array(context._jvm.double, 0)
    none = context._jvm.java.util.ArrayList()
    stages = context._jsc.sc().statusStore().stageList(none, False, False, quantiles, none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("floodsift-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config(map=RECOMMENDED)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.retainedStages", "1000000")  # shuffle_bytes sums over all of them
        .config("spark.ui.retainedJobs", "1000000")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds, shuffled = {}, {}
    for name in names:
        before = shuffle_bytes(spark)
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        shuffled[name] = shuffle_bytes(spark) - before
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": {n: round(events / s) for n, s in seconds.items()},
                "shuffle_bytes": shuffled,
                "events": events,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
