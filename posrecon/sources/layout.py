"""Positional layouts."""

from __future__ import annotations

from pyspark.sql import SparkSession

from posrecon.config import FormatConfig, LayoutField, resolve_path
from posrecon.sources.delimited import read_delimited


def load_layout(spark: SparkSession, path: str) -> list[LayoutField]:
    """Read a layout CSV with the columns From, Length, Field and (optional) Type.

    Header names are matched without regard to case; From counts from 1.
    """
    table = read_delimited(spark, path, ",", encoding="utf-8")
    table = table.toDF(*[c.strip().lower() for c in table.columns])
    out = []
    for row in table.collect():
        cells = row.asDict()
        start = int(cells["from"]) - 1
        kind = str(cells.get("type") or "text").strip().lower()
        out.append(LayoutField(str(cells["field"]).strip(), start, start + int(cells["length"]), kind))
    return out


def resolve_layouts(
    spark: SparkSession, config: FormatConfig, base_dir: str | None = None
) -> FormatConfig:
    """Load every layout file the configuration names (relative to ``base_dir``)."""
    loaded = {}
    for attr in ("layout", "header_layout", "detail_layout", "trailer_layout"):
        path = resolve_path(getattr(config, attr + "_file"), base_dir)
        if path and getattr(config, attr) is None:
            loaded[attr] = load_layout(spark, path)
    return config.with_(**loaded)
