"""Audit of saved configurations: one row per file with what is wrong in it."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posrecon.config import FormatConfig
from posrecon.plans.mapping import ROLE_FIELDS
from posrecon.sources.lines import FILE, as_paths

CONFIG_SCHEMA = (
    "version int, name string, file_type string, encoding string, has_header boolean, "
    "delimiter string, start_line int, record_type string, layout_file string, "
    "header_prefix string, header_layout_file string, detail_layout_file string, "
    "trailer_prefix string, trailer_layout_file string, ml_record_types array<string>, "
    "ml_delimiter string, schema array<string>, detected_columns array<string>, "
    "store_col string, upc_col string, desc_col string, units_col string, price_col string, "
    "price_type string, implied_dollars boolean, implied_units boolean"
)


def _unset(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def _no_items(name: str) -> Column:
    return F.coalesce(F.size(name), F.lit(0)) <= 0


def _missing_columns() -> Column:
    empty = F.array().cast("array<string>")
    known = F.concat(F.coalesce("schema", empty), F.coalesce("detected_columns", empty))
    mapped = F.array_compact(F.array(*[F.col(c) for c in ROLE_FIELDS.values()]))
    missing = F.array_sort(F.array_except(mapped, known))
    return F.when(
        (F.size(known) > 0) & (F.size(missing) > 0),
        F.concat(F.lit("Mapped columns not found in schema: "), F.array_join(missing, ", ")),
    )


def _messages(rules: list[tuple[Column, str]]) -> list[Column]:
    return [F.when(rule, text) for rule, text in rules]


def config_errors() -> Column:
    """All messages for a configuration held in columns of ``CONFIG_SCHEMA``."""
    fixed = F.col("file_type") == "fixed"
    multi = F.col("file_type") == "multiline"
    # The messages.
    rules = [
        (_unset("file_type"), "File type is not set (required: delimited, fixed, or multiline)."),
        (fixed & _unset("layout_file"), "Fixed-width files require a layout CSV file path."),
        (multi & ~_unset("header_prefix") & _unset("header_layout_file"),
         "HDR files require a header layout CSV."),
        (multi & ~_unset("header_prefix") & _unset("detail_layout_file"),
         "HDR files require a detail layout CSV."),
        (multi & _unset("header_prefix") & _no_items("ml_record_types"),
         "Multiline files require record type prefixes (e.g. H,D)."),
        (_no_items("schema") & _no_items("detected_columns"),
         "No schema or detected columns — cannot determine data structure."),
        (_unset("store_col"), "Store column mapping is required."),
        (_unset("upc_col"), "UPC column mapping is required."),
        (_unset("units_col"), "Units column mapping is required."),
        (_unset("price_col"), "Price column mapping is required."),
    ]
    return F.array_compact(F.array(*_messages(rules), _missing_columns()))


def audit_configs(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """One row per configuration file: its fields and ``errors`` (empty = valid)."""
    configs = (
        spark.read.schema(CONFIG_SCHEMA).option("multiLine", True).json(as_paths(paths))
    )
    return configs.select("*", F.col("_metadata.file_path").alias(FILE), config_errors().alias("errors"))


def validate_config(spark: SparkSession, config: FormatConfig) -> list[str]:
    """The same check for one configuration object."""
    fields = [part.split(" ")[0] for part in CONFIG_SCHEMA.split(", ")]
    values = asdict(config)
    row = spark.createDataFrame([tuple(values[f] for f in fields)], CONFIG_SCHEMA)
    return list(row.select(config_errors().alias("errors")).first()["errors"])


def assert_config_valid(spark: SparkSession, config: FormatConfig) -> None:
    errors = validate_config(spark, config)
    if errors:
        raise ValueError("Configuration validation failed:\n  - " + "\n  - ".join(errors))
