"""One entry point for every file format a configuration can describe."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession

from posrecon.config import FormatConfig
from posrecon.sources.delimited import read_delimited, rename_positional
from posrecon.sources.fixed import read_fixed_width
from posrecon.sources.records import read_records
from posrecon.sources.transactions import read_transactions


def is_transaction_format(config: FormatConfig) -> bool:
    return bool(config.file_type == "multiline" and config.header_prefix and config.header_layout)


def cell_encoding(config: FormatConfig) -> str:
    """cp1252 is what configurations say by default, so valid UTF-8 is believed first."""
    return "auto" if config.encoding == "cp1252" else config.encoding


def read_pos(
    spark: SparkSession,
    paths: str | Iterable[str],
    config: FormatConfig,
    with_file: bool = False,
    seen: Observation | None = None,
) -> DataFrame:
    """Read raw text columns as the configuration says.

    ``seen`` gets the reader's own counts (header / detail / trailer files: details and orphans).

    A delimited file marked cp1252 (the configuration default) is read as UTF-8
    where its bytes are valid UTF-8 and as cp1252 elsewhere.
    """
    if config.file_type == "delimited":
        return read_delimited(
            spark, paths, config.delimiter,
            column_names=config.schema if not config.has_header else None,
            has_header=config.has_header,
            start_line=config.start_line,
            encoding=cell_encoding(config),
            mixed_headers=config.mixed_headers,
            pad_ragged=config.pad_ragged,
            quoted_newlines=config.quoted_newlines,
            with_file=with_file,
            header_names=config.schema or config.detected_columns,
            numeric=(config.units_col, config.price_col),
        )
    if config.file_type == "fixed":
        df = read_fixed_width(
            spark, paths, config.layout, config.start_line, config.record_type,
            config.encoding, with_file,
        )
        return rename_positional(df, config.schema)
    if config.file_type == "multiline":
        if is_transaction_format(config):
            df = read_transactions(
                spark, paths, config.header_prefix, config.header_layout,
                config.detail_layout or config.layout,
                config.trailer_prefix, config.trailer_layout, config.encoding, with_file, seen=seen,
            )
            return rename_positional(df, config.schema)
        return read_records(
            spark, paths, config.ml_record_types, config.ml_delimiter, config.schema,
            config.encoding, with_file,
        )
    raise ValueError(f"Unsupported file type: {config.file_type}")
