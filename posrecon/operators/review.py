"""File review: distinct stores and UPCs, total units and dollars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posrecon.config import FormatConfig
from posrecon.functions.measures import total
from posrecon.functions.text import strip
from posrecon.operators import tagged
from posrecon.operators.canonical import measures
from posrecon.sources.lines import FILE, file_name


def review_rows(df: DataFrame, config: FormatConfig) -> DataFrame:
    """The columns a file review needs, from raw rows that carry ``source_file``."""
    config.require("store_col", "upc_col", "units_col", "price_col")
    units, dollars = measures(
        df, config.units_col, config.price_col, config.implied_units, config.implied_dollars
    )
    return df.select(
        FILE,
        F.col(f"`{config.store_col}`").cast("string").alias("store"),
        strip(F.col(f"`{config.upc_col}`").cast("string")).alias("upc"),
        units.alias("units"),
        dollars.alias("dollars"),
    )


def file_review(
    rows: DataFrame, files: DataFrame | None = None, exact: bool | int = False
) -> DataFrame:
    """One row per file from one scan.

    ``rows`` come from :func:`review_rows`. They are grouped by (file, store) and
    (file, UPC) before anything is counted per file, so one file holding most rows
    still spreads out. ``files`` (``source_file, filename``) adds files without
    rows as zeros.
    """
    # Each row feeds one group per (file, store) and one per (file, UPC). The groups are
    # what the counts count (a null key is a group too); the store groups carry the sums.
    groups = rows.groupingSets(
        [[F.col(FILE), F.col("store")], [F.col(FILE), F.col("upc")]], FILE, "store", "upc"
    ).agg(
        F.grouping("store").alias("by_upc"),
        total("units", exact).alias("units"),
        total("dollars", exact).alias("dollars"),
    )
    return _per_file(groups, F.col("by_upc") == 0, files, exact)


def review_of_summary(summary: DataFrame, side: int, exact: bool | int = False) -> DataFrame:
    """One row per file of a side, from the groups of a run's summary."""
    p = tagged.SIDES[side]
    groups = summary.where(F.col("level").isin("file_store", "file_upc") & (F.col(tagged.SIDE) == side)).select(
        FILE, (F.col("level") == "file_store").alias("of_store"),
        F.col(p + "Units").alias("units"), F.col(p + "TOTAL_DOLLARS").alias("dollars"),
    )
    return _per_file(groups, F.col("of_store"), None, exact)


def _per_file(groups: DataFrame, of_store: Column, files: DataFrame | None, exact: bool | int) -> DataFrame:
    per_file = groups.groupBy(FILE).agg(
        F.count_if(of_store).alias("store_count"),
        F.count_if(~of_store).alias("upc_count"),
        total(F.when(of_store, F.col("units")), exact).alias("total_units"),
        total(F.when(of_store, F.col("dollars")), exact).alias("total_dollars"),
    )
    if files is not None:
        per_file = files.select(FILE).join(per_file, FILE, "left").fillna(0)
    return per_file.select(
        file_name(F.col(FILE)).alias("filename"),
        F.col("store_count").cast("long").alias("store_count"),
        F.col("upc_count").cast("long").alias("upc_count"),
        "total_units",
        F.round("total_dollars", 2).alias("total_dollars"),
    )


def review_from_summaries(
    store_summary: DataFrame, upc_summary: DataFrame, file_names: list[str], exact: bool | int = False
) -> DataFrame:
    """One consolidated row from summaries that already exist."""
    name = (
        file_names[0].rstrip("/").rsplit("/", 1)[-1]
        if len(file_names) == 1
        else f"{len(file_names)} files (aggregated)"
    )
    stores = store_summary.agg(F.count(F.lit(1)).alias("store_count"))
    return upc_summary.agg(
        F.count(F.lit(1)).alias("upc_count"),
        F.coalesce(total("UNITS_SOLD", exact), F.lit(0.0)).alias("total_units"),
        F.coalesce(total("TOTAL_DOLLARS", exact), F.lit(0.0)).alias("total_dollars"),
    ).select(
        F.lit(name).alias("filename"),
        stores.scalar().alias("store_count"),
        "upc_count",
        "total_units",
        F.round("total_dollars", 2).alias("total_dollars"),
    )
