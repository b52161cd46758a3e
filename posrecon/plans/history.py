"""Run history: one appended row per run."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY_SCHEMA = (
    "timestamp timestamp, files_processed long, rows_processed long, execution_time double, "
    "rows_failed long, warnings long, errors long"
)
MAX_HISTORY = 10


def record_run(
    spark: SparkSession,
    path: str,
    files_processed: int = 0,
    rows_processed: int = 0,
    execution_time: float = 0.0,
    rows_failed: int = 0,
    warnings: int = 0,
    errors: int = 0,
    timestamp: datetime.datetime | None = None,
) -> None:
    row = (
        timestamp or datetime.datetime.now(), files_processed, rows_processed,
        round(float(execution_time), 2), rows_failed, warnings, errors,
    )
    spark.createDataFrame([row], HISTORY_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def last_runs(spark: SparkSession, path: str, n: int = MAX_HISTORY) -> DataFrame:
    """The latest ``n`` runs, newest first."""
    return spark.read.schema(HISTORY_SCHEMA).parquet(path).orderBy(F.desc("timestamp")).limit(n)
