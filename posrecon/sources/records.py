"""Delimited files whose first field is a record type (``H|...``, ``D|...``)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posrecon.config import DEFAULT_RECORD_TYPES
from posrecon.functions.text import split_literal
from posrecon.sources.lines import FILE, VALUE, read_lines

_CELLS = "__cells"


def record_body(line: Column, record_types: Iterable[str], delimiter: str) -> Column:
    """What follows the first matching record type and one delimiter; null if none match."""
    body = None
    for kind in record_types:
        rest = F.substr(line, F.lit(len(kind) + 1))
        rest = F.when(
            F.startswith(rest, F.lit(delimiter)), F.substr(rest, F.lit(len(delimiter) + 1))
        ).otherwise(rest)
        hit = F.startswith(line, F.lit(kind))
        body = F.when(hit, rest) if body is None else body.when(hit, rest)
    return body


def read_records(
    spark: SparkSession,
    paths: str | Iterable[str],
    record_types: Iterable[str] | None = None,
    delimiter: str = "|",
    column_names: list[str] | None = None,
    encoding: str = "cp1252",
    with_file: bool = False,
) -> DataFrame:
    """Keep lines of the given record types and split them into text columns.

    With ``column_names`` the read is one pass and a wider row stops the job.
    Without names the width is that of the widest row (one extra pass) and columns
    are called ``Column_0``, ``Column_1``, ... Short rows are padded with ``""``.
    """
    keep = record_filter(record_types, delimiter)
    lines = read_lines(spark, paths, encoding, keep=keep, with_file=with_file)
    return split_records(
        lines, record_types, delimiter, column_names, with_file, filtered=keep is not None
    )


def record_filter(record_types: Iterable[str] | None, delimiter: str) -> Column | None:
    """Test an undecoded line: a listed type with something after it. None where
    types or delimiter need the decoded text."""
    types = list(record_types or DEFAULT_RECORD_TYPES)
    if not all(t.isascii() for t in [*types, delimiter]):
        return None
    return F.coalesce(record_body(F.col(VALUE), types, delimiter) != "", F.lit(False))


def split_records(
    lines: DataFrame,
    record_types: Iterable[str] | None = None,
    delimiter: str = "|",
    column_names: list[str] | None = None,
    with_file: bool = False,
    filtered: bool = False,
) -> DataFrame:
    """Record rows of lines that are already read (and ``filtered``, if so)."""
    types = list(record_types or DEFAULT_RECORD_TYPES)
    file = [F.col(FILE)] if with_file else []
    body = lines.select(record_body(F.col(VALUE), types, delimiter).alias("__body"), *file)
    if not filtered:
        body = body.where(F.col("__body") != "")
    split = split_literal(F.col("__body"), delimiter)
    if column_names:
        names = list(column_names)
        # In the projection, not in a filter: there the split is computed once.
        too_wide = F.raise_error(
            F.concat(F.lit(f"{len(names)} column names for a row of "), F.size(split).cast("string"))
        )
        checked = F.when(F.size(split) <= len(names), split).otherwise(too_wide.cast("array<string>"))
        cells = body.select(checked.alias(_CELLS), *file)
    else:
        cells = body.select(split.alias(_CELLS), *file)
        width = cells.agg(F.max(F.size(_CELLS))).first()[0] or 0
        names = [f"Column_{i}" for i in range(width)]
    return cells.select(
        *[F.coalesce(F.get(_CELLS, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)],
        *file,
    )
