"""The level summaries over a folder that keeps receiving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posrecon.config import FormatConfig
from posrecon.functions.text import decode_bytes
from posrecon.operators.canonical import to_rows
from posrecon.operators.summarize import aggregate
from posrecon.sources.delimited import csv_reader, decoded_cells, text_schema
from posrecon.sources.dispatch import cell_encoding
from posrecon.sources.fixed import cut_fields
from posrecon.sources.lines import FILE, VALUE
from posrecon.sources.records import record_filter, split_records
from posrecon.streaming.summary_table import SummaryTable


def stream_summary(
    spark: SparkSession, folder: str, config: FormatConfig, level: str, exact: bool | int = False
) -> DataFrame:
    """Streaming summary; write it in complete or update mode.

    Same plan as the batch one: state holds one row per key. Formats whose lines
    stand alone qualify (delimited, fixed, record types with a schema); transaction
    files need whole-file order and start lines do too, so both are refused.
    """
    return aggregate(stream_rows(spark, folder, config), level, config, exact, ordered=False)


def stream_into(spark: SparkSession, folder: str, config: FormatConfig, table: SummaryTable, max_files: int | None = None):
    """A stream writer that adds every file of the folder to a growing summary table, once.

    No state is kept in the stream: a batch is summed, and only the buckets it touches are rewritten.
    """
    rows = to_rows(stream_rows(spark, folder, config, with_file=True, max_files=max_files), table.level, config)

    def add(batch: DataFrame, _: int) -> None:
        table.add(batch)

    return rows.writeStream.foreachBatch(add)


def stream_rows(
    spark: SparkSession, folder: str, config: FormatConfig, with_file: bool = False, max_files: int | None = None
) -> DataFrame:
    """Raw columns of the files that land in a folder."""
    if config.start_line or (config.file_type == "multiline" and config.header_prefix):
        raise ValueError("this format depends on line order and cannot be streamed")
    source = spark.readStream if max_files is None else spark.readStream.option("maxFilesPerTrigger", max_files)
    file = [F.col("_metadata.file_path").alias(FILE)] if with_file else []
    if config.file_type == "delimited":
        if not config.schema:
            raise ValueError("a streamed delimited file needs its column names in schema")
        encoding = cell_encoding(config)
        reader = csv_reader(source, config.delimiter or ",", config.has_header, encoding)
        raw = reader.schema(text_schema(config.schema)).csv(folder)
        raw = raw.select(*decoded_cells(raw, encoding, (config.units_col, config.price_col)), *file)
    else:
        raw_lines = source.text(folder)
        keep = record_filter(config.ml_record_types, config.ml_delimiter)
        if config.file_type == "multiline" and keep is not None:
            raw_lines = raw_lines.where(keep)
        text = decode_bytes(F.col("value").cast("binary"), config.encoding)
        lines = raw_lines.select(text.alias(VALUE), *file)
        if config.file_type == "fixed":
            raw = cut_fields(lines, config.layout, config.record_type, with_file)
        elif config.file_type == "multiline" and config.schema:
            raw = split_records(
                lines, config.ml_record_types, config.ml_delimiter, config.schema,
                with_file, filtered=keep is not None,
            )
        else:
            raise ValueError("record files need a schema to be streamed")
    return raw
