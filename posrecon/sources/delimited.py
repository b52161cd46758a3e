"""Delimited files: header row plus text columns."""

from __future__ import annotations

import csv
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posrecon.functions.text import normal_encoding, redecode_latin1
from posrecon.shared import stored
from posrecon.sources.lines import (
    BLOCK,
    FILE,
    FILE_ID,
    LINE_NO,
    SEQ,
    VALUE,
    as_paths,
    file_name,
    head_lines,
    one_path_per_id,
    read_lines,
    skip_lines,
    with_index,
)
from posrecon.sources.quoted import quoted_records

#: A file's header begins within so many bytes of its start.
HEAD_BYTES = 1 << 20


def _csv_options(delimiter: str) -> dict[str, str]:
    return {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def rename_positional(df: DataFrame, names: list[str] | None) -> DataFrame:
    """Name columns by position; a wrong number of names is an error."""
    if not names:
        return df
    data = [c for c in df.columns if c != FILE]
    if len(names) != len(data):
        raise ValueError(f"{len(names)} column names for {len(data)} columns")
    return df.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(data, names)],
        *([F.col(FILE)] if FILE in df.columns else []),
    )


def read_delimited(
    spark: SparkSession,
    paths: str | Iterable[str],
    delimiter: str | None = ",",
    columns: list[str] | None = None,
    column_names: list[str] | None = None,
    has_header: bool = True,
    start_line: int = 0,
    encoding: str = "utf-8",
    mixed_headers: bool = False,
    pad_ragged: bool = False,
    quoted_newlines: bool = False,
    with_file: bool = False,
    header_names: list[str] | None = None,
    numeric: tuple[str, ...] = (),
) -> DataFrame:
    """All files as one table of text columns.

    Every file has its own header. Files whose header differs from the first one
    stop the job, unless ``mixed_headers`` is set: then cells go to columns by the
    names in their file's header (in any case), and a column that a file lacks is null there. Short rows are padded with nulls (with
    ``""`` under ``pad_ragged``), extra cells are dropped. ``columns`` prunes the
    scan; ``with_file`` adds ``source_file``. ``header_names`` states the header when
    it is already known: every file is checked against it and none is sampled.
    Columns named in ``numeric`` are not decoded: only their ASCII characters count.
    ``start_line`` skips lines before the header; ``quoted_newlines`` lets quoted cells contain line breaks. All of these
    go together, and files split under each of them.
    """
    delimiter = delimiter or ","
    paths = as_paths(paths)
    if start_line > 0 or quoted_newlines or (mixed_headers and has_header):
        df = _read_as_records(
            spark, paths, delimiter, has_header, start_line, encoding, mixed_headers, quoted_newlines, header_names, numeric
        )
    else:
        df = _read_native(spark, paths, delimiter, has_header, encoding, with_file, header_names, numeric)
    df = rename_positional(df, column_names)
    keep = columns or [c for c in df.columns if c != FILE]
    cells = [F.col(f"`{c}`") for c in keep]
    if pad_ragged:
        cells = [F.coalesce(c, F.lit("")).alias(n) for c, n in zip(cells, keep)]
    return df.select(*cells, *([F.col(FILE)] if with_file else []))


def _read_native(
    spark: SparkSession,
    paths: list[str],
    delimiter: str,
    has_header: bool,
    encoding: str,
    with_file: bool = False,
    header_names: list[str] | None = None,
    numeric: tuple[str, ...] = (),
) -> DataFrame:
    reader = csv_reader(spark.read, delimiter, has_header, encoding)
    if has_header and header_names:
        reader = reader.schema(text_schema(header_names))
    raw = reader.csv(paths)
    cells = decoded_cells(raw, encoding, numeric)
    return raw.select(*cells, *([F.col("_metadata.file_path").alias(FILE)] if with_file else []))


def text_schema(names: list[str]) -> str:
    return ", ".join(f"`{n}` string" for n in names)


def csv_reader(reader, delimiter: str, has_header: bool, encoding: str):
    """Options of a batch or streaming reader; its cells need :func:`decoded_cells`."""
    utf8 = normal_encoding(encoding) == "utf-8"
    return (
        reader.options(**_csv_options(delimiter))
        .option("header", has_header)
        .option("enforceSchema", not has_header)
        .option("encoding", "UTF-8" if utf8 else "ISO-8859-1")
    )


def decoded_cells(raw: DataFrame, encoding: str, numeric: tuple[str, ...] = ()) -> list[Column]:
    """The cells of :func:`csv_reader` as text of the given encoding."""
    enc = normal_encoding(encoding)
    cells = [F.col(f"`{c}`") for c in raw.columns]
    if enc == "utf-8":
        return cells
    return [c if n in numeric else redecode_latin1(c, enc).alias(n) for c, n in zip(cells, raw.columns)]


def column_names_of(header: str, delimiter: str) -> list[str]:
    """Names in a header line: empty ones are numbered, and so are those that occur twice, as in Spark's own reader."""
    cells = next(csv.reader([header], delimiter=delimiter)) if len(delimiter) == 1 else header.split(delimiter)
    lower = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if lower.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def _first_records(lines: DataFrame, delimiter: str, quoted: bool) -> DataFrame:
    """The first record of every file that is not blank."""
    head = lines.where(F.col(BLOCK) < HEAD_BYTES)
    records = quoted_records(head, delimiter) if quoted else head
    return head_lines(records.where(F.col(VALUE) != "").drop(LINE_NO), 1)


def _read_as_records(
    spark: SparkSession,
    paths: list[str],
    delimiter: str,
    has_header: bool,
    start_line: int,
    encoding: str,
    mixed_headers: bool,
    quoted: bool,
    header_names: list[str] | None,
    numeric: tuple[str, ...],
) -> DataFrame:
    """Lines (or records of several lines) parsed one by one, whatever their file's header.

    Distinct headers alone come to the driver. Every file gets the number of its header and the position of
    it in an index of numbers; one scan takes each cell to the column that the header of its file names.
    """
    lines = skip_lines(read_lines(spark, paths, "latin-1", ordered=True), start_line)
    first = stored(_first_records(lines, delimiter, quoted).select(FILE, FILE_ID, BLOCK, SEQ, VALUE))
    found = [r[0] for r in first.select(VALUE).distinct().orderBy(VALUE).collect()] if has_header else []
    named = [column_names_of(h, delimiter) for h in found]
    if has_header and not found:
        if header_names or start_line <= 0:
            return _read_native(spark, paths, delimiter, True, encoding, True, header_names, numeric)
        raise ValueError(f"no line {start_line + 1} in any input file")
    if not has_header:
        top = first.orderBy(FILE).first()
        named = [[f"_c{i}" for i in range(len(column_names_of(top[VALUE], delimiter)) if top else 0)]]
    elif not mixed_headers and (len(found) > 1 or (header_names and named[0] != list(header_names))):
        raise ValueError(f"header differs between files: {' / '.join(found[:3])}")
    records = (quoted_records(lines, delimiter) if quoted else lines).where(F.col(VALUE) != "")
    number = F.lit(0)
    if has_header:
        positions = F.create_map(*[x for k, h in enumerate(found) for x in (F.lit(h), F.lit(k))])
        index = one_path_per_id(first).where(F.col(FILE).isNotNull()).select(
            FILE_ID, F.element_at(positions, F.col(VALUE)).alias("__header"),
            F.col(BLOCK).alias("__head_block"), F.col(SEQ).alias("__head_seq"),
        )
        records = with_index(records, index, [FILE_ID], first.count())
        is_header = (F.col(BLOCK) == F.col("__head_block")) & (F.col(SEQ) == F.col("__head_seq"))
        records = records.where(
            F.when(F.col("__header").isNotNull(), ~is_header).otherwise(
                F.raise_error(F.lit(f"no header in the first {HEAD_BYTES} bytes of a file")).cast("boolean")
            )
        )
        number = F.col("__header")
    width = max(map(len, named))
    row = F.from_csv(VALUE, ", ".join(f"c{i} string" for i in range(width)) or "c0 string", _csv_options(delimiter))
    parsed = records.select(row.alias("__row"), number.alias("__header"), FILE)
    names: dict[str, str] = {}
    for n in (n for h in named for n in h):
        names.setdefault(n.lower(), n)
    return parsed.select(*[_named_cell(n, named, encoding, n in numeric) for n in names.values()], FILE)


def _named_cell(name: str, headers: list[list[str]], encoding: str, numeric: bool) -> Column:
    """The cell of a column, wherever the row's header has it."""
    places: dict[int, list[int]] = {}
    for k, names in enumerate(headers):
        lower = [n.lower() for n in names]
        if name.lower() in lower:
            places.setdefault(lower.index(name.lower()), []).append(k)
    if len(places) == 1 and len(next(iter(places.values()))) == len(headers):
        cell = F.col(f"__row.c{next(iter(places))}")
    else:
        options = [F.when(F.col("__header").isin(hs), F.col(f"__row.c{i}")) for i, hs in places.items()]
        cell = F.coalesce(*options)
    return (cell if numeric else redecode_latin1(cell, normal_encoding(encoding))).alias(
        name if numeric else _decoded_name(name, encoding)
    )


def _decoded_name(name: str, encoding: str) -> str:
    """A header read byte by byte, as text of the given encoding."""
    raw, enc = name.encode("latin-1"), normal_encoding(encoding)
    if enc == "latin-1":
        return name
    if enc in ("utf-8", "auto"):
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            if enc == "utf-8":
                return raw.decode("utf-8", errors="replace")
    return raw.decode("cp1252", errors="ignore")


def list_files(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """Input files, one row each (contents are not read)."""
    files = spark.read.format("binaryFile").load(as_paths(paths))
    return files.select(
        F.col("_metadata.file_path").alias(FILE),
        file_name(F.col("_metadata.file_path")).alias("filename"),
        F.col("_metadata.file_size").alias("bytes"),
    )
