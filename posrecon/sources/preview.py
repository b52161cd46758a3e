"""First rows of the first file, for a person to look at.

Lines are taken from the start of the file until enough rows are complete: ``take`` reads the first split only,
and of it no more than it must. State that lines above set (a header, the number of lines skipped) is carried
through these lines; a row that waits for its trailer is shown once the trailer has come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posrecon.config import as_layout
from posrecon.functions.text import slice_field, split_literal
from posrecon.sources.delimited import list_files
from posrecon.sources.lines import BLOCK, FILE, FILE_ID, SEQ, VALUE, as_paths, plain_path, read_lines
from posrecon.sources.records import record_body
from posrecon.sources.transactions import flatten_transactions

PREVIEW_ROWS = 20
#: A preview looks at no more lines than this; rows that are not complete by then are shown as they are.
PREVIEW_LINES = 65_536


def first_file(spark: SparkSession, paths: str | Iterable[str]) -> str:
    """The first file with content, by path; the first path itself if there is none."""
    paths = as_paths(paths)
    found = list_files(spark, paths).where(F.col("bytes") > 0).agg(F.min(FILE)).first()[0]
    return plain_path(found) if found else paths[0]


def leading_lines(
    spark: SparkSession, paths: str | Iterable[str], enough: Callable[[list[str]], bool], encoding: str = "cp1252"
) -> list[str]:
    """Lines from the start of the first file, until ``enough`` of them or the end of the file."""
    lines = read_lines(spark, first_file(spark, paths), encoding).select(VALUE)
    n = 64
    while True:
        got = [r[0] for r in lines.take(n)]
        if len(got) < n or n >= PREVIEW_LINES or enough(got):
            return got
        n = min(4 * n, PREVIEW_LINES)


def preview_raw(
    spark: SparkSession,
    paths: str | Iterable[str],
    file_type: str,
    delimiter: str = ",",
    layout=None,
    n_rows: int = PREVIEW_ROWS,
    start_line: int = 0,
    record_type: str | None = None,
    encoding: str = "cp1252",
) -> DataFrame:
    """Unprocessed look at a file: plain split, untyped slices, or whole lines.

    For delimited files the first of the ``n_rows`` lines names the columns.
    """
    if file_type not in ("delimited", "fixed", "multiline"):
        raise ValueError(f"Unsupported file type: {file_type}")
    skip = 0 if file_type == "multiline" else start_line
    prefix = (record_type or "") if file_type == "fixed" else ""
    shown = lambda lines: [x for x in lines[skip:] if x and x.startswith(prefix)]
    lines = shown(leading_lines(spark, paths, lambda got: len(shown(got)) >= n_rows, encoding))[:n_rows]
    if file_type == "multiline":
        return spark.createDataFrame([(x,) for x in lines], "raw_line string")
    if file_type == "fixed":
        frame = spark.createDataFrame([(x,) for x in lines], "value string")
        return frame.select(
            *[slice_field(F.col(VALUE), f, apply_type=False).alias(f.field) for f in as_layout(layout)]
        )
    cells = [x.split(delimiter) for x in lines]
    if not cells:
        return spark.createDataFrame([], "value string")
    names, rows = cells[0], cells[1:]
    if not rows:
        names, rows = [f"column_{i}" for i in range(len(names))], cells
    width = len(names)
    rows = [tuple((r + [None] * width)[:width]) for r in rows]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


def preview_records(
    spark: SparkSession,
    paths: str | Iterable[str],
    record_types: Iterable[str],
    delimiter: str = "|",
    n_rows: int = PREVIEW_ROWS,
) -> DataFrame:
    """First flattened record rows; the width is that of the lines shown."""
    types = list(record_types)
    body = record_body(F.col(VALUE), types, delimiter)

    def has_body(line: str) -> bool:
        kind = next((t for t in types if line.startswith(t)), None)
        return kind is not None and line[len(kind):].removeprefix(delimiter) != ""

    lines = leading_lines(spark, paths, lambda got: sum(map(has_body, got)) >= n_rows)
    frame = spark.createDataFrame([(x,) for x in lines if has_body(x)][:n_rows], "value string").select(
        split_literal(body, delimiter).alias("cells")
    )
    width = frame.agg(F.max(F.size("cells"))).first()[0] or 0
    return frame.select(
        *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(f"Column_{i}") for i in range(width)]
    )


def preview_transactions(
    spark: SparkSession,
    paths: str | Iterable[str],
    header_prefix: str,
    header_layout,
    detail_layout,
    n_rows: int = PREVIEW_ROWS,
    trailer_prefix: str | None = None,
    trailer_layout=None,
) -> DataFrame:
    """First details with the fields of their header and, as soon as it has come, their trailer."""

    def complete(lines: list[str]) -> bool:
        shown = waiting = 0
        is_open = False
        for line in lines:
            if line.startswith(header_prefix):
                is_open = True
            elif trailer_prefix and line.startswith(trailer_prefix):
                shown, waiting, is_open = shown + waiting, 0, False
            elif line and is_open:
                waiting += 1
        return shown + (0 if trailer_prefix else waiting) >= n_rows

    lines = [x for x in leading_lines(spark, paths, complete) if x]
    placed = spark.createDataFrame(list(enumerate(lines)), f"{SEQ} long, {VALUE} string").select(
        F.lit("").alias(FILE), F.lit(0).cast("long").alias(FILE_ID), F.lit(0).cast("long").alias(BLOCK), SEQ, VALUE
    )
    rows = flatten_transactions(
        placed, header_prefix, header_layout, detail_layout, trailer_prefix, trailer_layout, with_position=True
    )
    return rows.orderBy(BLOCK, SEQ).limit(n_rows).drop(BLOCK, SEQ)
