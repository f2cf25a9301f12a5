"""Times every catalog query and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default all), BENCH_RUNS (default 1).
The derived files are written first; that time is reported as ``corpus``.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from checks import catalog, corpus


def seconds(work) -> float:
    started = time.perf_counter()
    work()
    return round(time.perf_counter() - started, 3)


def run(query, spark: SparkSession, folder: str) -> None:
    query(spark, folder).write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("modcensus-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.all_queries()
    chosen = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name] or list(queries)
    corpus_seconds = seconds(lambda: (corpus.files(spark, folder), corpus.file_contents(spark, folder)))
    times = {}
    for name in chosen:
        times[name] = min(seconds(lambda: run(queries[name], spark, folder)) for _ in range(runs))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total query time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "corpus": corpus_seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
