"""Headline timings on local Spark; prints one JSON line.

Environment: ``BENCH_SF_DIR`` (tables, default /root/testdata/sf0.1) and
a CSV folder with the columns Store, UPC, Description, Units, Price made from
``lineitem`` (written before the clock starts). The ``large_*`` stages do the same over two
different sides of 400 MB and more each, the rows of ``lineitem`` repeated. Every query runs twice to warm the
JVM (large ones once); the value is the median of the next three runs, each computing all rows. ``per_row``
gives nanoseconds a row for the CSV stages.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from posrecon.catalog import sides
from posrecon.catalog.queries import QUERIES
from posrecon.operators.canonical import to_rows
from posrecon.operators.compare import store_validation
from posrecon.operators.review import file_review, review_rows
from posrecon.operators.summarize import aggregate
from posrecon.plans.reconcile import reconcile
from posrecon.shared import scratch_dir
from posrecon.sources.dispatch import read_pos

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM_UPS = 2
RUNS = 3

HEADLINE = [
    "store_summary", "item_summary_rows", "upc_summary", "store_validation", "item_validation",
    "item_presence_summary", "store_ranked", "item_ranked", "store_top_k", "store_list_compare",
    "read_fixed_width_item", "read_records_store", "read_transactions_trailer", "file_review",
    "audit_inner_diff", "audit_upc_agreement", "audit_desc_mismatch", "audit_mismatch_report",
]


LARGE_ROWS = 8_000_000


def csv_stages(spark: SparkSession, bau: str, test: str, name: str) -> dict:
    config = sides.TABLE_CONFIG

    def raw(path: str, with_file: bool = False):
        return read_pos(spark, path, config, with_file)

    def validation():
        return store_validation(*(to_rows(raw(p), "store", config) for p in (bau, test)))

    return {
        f"{name}_store": lambda: aggregate(raw(bau), "store", config),
        f"{name}_item": lambda: aggregate(raw(bau), "item", config),
        f"{name}_review": lambda: file_review(review_rows(raw(bau, True), config)),
        f"{name}_validation": validation,
    }


def large_sides(spark: SparkSession) -> tuple[list[str], int]:
    """Both sides as CSV folders with ``LARGE_ROWS`` rows or more."""
    rows = sides.bau(spark, SF_DIR).count()
    times = -(-LARGE_ROWS // rows)
    paths = []
    for side in (sides.bau, sides.test):
        paths.append(f"{scratch_dir(spark)}/large")
        many = side(spark, SF_DIR).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
        many.select(*sides.RAW).write.option("header", True).csv(paths[-1])
    return paths, rows * times


def whole_run(spark: SparkSession, bau: str, test: str):
    """All reports of a two-sided run, reviews per file included, from one scan of each side."""
    config = sides.TABLE_CONFIG
    run = reconcile(read_pos(spark, bau, config, True), read_pos(spark, test, config, True), config, config)
    for frame in run.frames.values():
        frame.write.format("noop").mode("overwrite").save()
    run.release()


def timed(make) -> float:
    start = time.perf_counter()
    made = make()
    if made is not None:
        made.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("posrecon-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        # Call sites of every column expression are for debugging; they slow plan building.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    path = sides.raw_files(spark, SF_DIR, "bau", "delimited")
    jobs = csv_stages(spark, path, path, "csv")
    jobs |= {name: (lambda q=QUERIES[name]: q(spark, SF_DIR)) for name in HEADLINE}
    seconds = {}
    for name, make in jobs.items():
        for _ in range(WARM_UPS):
            timed(make)
        seconds[name] = round(statistics.median(timed(make) for _ in range(RUNS)), 3)
    rows = dict.fromkeys((n for n in seconds if n.startswith("csv_")), sides.bau(spark, SF_DIR).count())
    (bau, test), large = large_sides(spark)
    jobs = csv_stages(spark, bau, test, "large") | {"large_run": lambda: whole_run(spark, bau, test)}
    for name, make in jobs.items():
        timed(make)
        seconds[name] = round(timed(make), 3)
        rows[name] = large * (2 if name in ("large_validation", "large_run") else 1)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                # The large stages came later: without them the total compares with earlier ones.
                "value": round(sum(v for n, v in seconds.items() if not n.startswith("large_")), 3),
                "unit": "sec",
                "queries": seconds,
                "per_row": {n: round(1e9 * seconds[n] / r) for n, r in rows.items()},
                "sf": SF_DIR.rstrip("/").rsplit("/", 1)[-1].removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
