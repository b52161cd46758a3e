"""Fixed-width files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posrecon.config import as_layout
from posrecon.functions.text import slice_field
from posrecon.sources.lines import FILE, VALUE, read_lines, skip_lines, starts_with


def read_fixed_width(
    spark: SparkSession,
    paths: str | Iterable[str],
    layout,
    start_line: int = 0,
    record_type: str | None = None,
    encoding: str = "cp1252",
    with_file: bool = False,
) -> DataFrame:
    """One text column per layout field.

    ``record_type`` keeps the lines that start with it. Blank lines stay as empty
    records. Without ``start_line`` the scan is a pure map over splits; with it,
    lines are numbered per (file, block) first.
    """
    if start_line <= 0 and record_type and record_type.isascii():
        keep = starts_with(record_type)
        lines = read_lines(spark, paths, encoding, keep=keep, with_file=with_file)
        return cut_fields(lines, layout, None, with_file)
    lines = read_lines(spark, paths, encoding, ordered=start_line > 0, with_file=with_file)
    return cut_fields(skip_lines(lines, start_line), layout, record_type, with_file)


def cut_fields(
    lines: DataFrame, layout, record_type: str | None = None, with_file: bool = False
) -> DataFrame:
    """Layout fields of lines that are already read."""
    fields = as_layout(layout)
    if not fields:
        raise ValueError("a fixed-width file needs a layout")
    if record_type:
        lines = lines.where(F.startswith(F.col(VALUE), F.lit(record_type)))
    return lines.select(
        *[slice_field(F.col(VALUE), f).alias(f.field) for f in fields],
        *([F.col(FILE)] if with_file else []),
    )
