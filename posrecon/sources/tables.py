"""Other inputs: store lists, Parquet sides, encoding-tolerant CSV."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from posrecon.sources.delimited import read_delimited
from posrecon.sources.lines import as_paths


def read_csv_tolerant(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """CSV in UTF-8 or cp1252; an empty file gives a frame without columns."""
    return read_delimited(spark, path, delimiter, encoding="auto")


def read_store_list(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Store list, every column as text so that leading zeros survive."""
    return read_csv_tolerant(spark, path, delimiter)


def read_side_parquet(
    spark: SparkSession, paths: str | Iterable[str], columns: list[str] | None = None
) -> DataFrame:
    """Row-level Parquet output of one side; ``columns`` prunes the scan."""
    df = spark.read.parquet(*as_paths(paths))
    return df.select(*columns) if columns else df
