"""Raw text columns to canonical store, item and UPC rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from posrecon.config import TOTAL_PRICE, FormatConfig
from posrecon.functions.measures import is_bad_measure, line_total, safe_numeric, scaled
from posrecon.functions.text import strip
from posrecon.sources.lines import FILE


def _ref(name: str) -> Column:
    return F.col(f"`{name}`")


def measure(df: DataFrame, name: str) -> Column:
    """A measure as double; numeric columns skip the text parsing."""
    if isinstance(df.schema[name].dataType, NumericType):
        return F.coalesce(F.nanvl(_ref(name).cast("double"), F.lit(0.0)), F.lit(0.0))
    return safe_numeric(_ref(name))


def measures(
    df: DataFrame,
    units_col: str,
    price_col: str,
    implied_units: bool = False,
    implied_dollars: bool = False,
    price_type: str = TOTAL_PRICE,
) -> tuple[Column, Column]:
    """Units and dollars: implied decimals first, then unit price times units."""
    units = scaled(measure(df, units_col), implied_units)
    price = scaled(measure(df, price_col), implied_dollars)
    return units, line_total(units, price, price_type)


def _text_key(name: str) -> Column:
    return strip(_ref(name).cast("string"))


def _require(df: DataFrame, *names: str | None) -> None:
    missing = [str(n) for n in names if not n or n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)} (have: {', '.join(df.columns)})")


def _file_column(df: DataFrame) -> list[Column]:
    return [F.col(FILE)] if FILE in df.columns else []


def to_store_rows(
    df: DataFrame,
    store_col: str,
    units_col: str,
    price_col: str,
    implied_units: bool = False,
    implied_dollars: bool = False,
    price_type: str = TOTAL_PRICE,
) -> DataFrame:
    """``STORE_NUMBER`` (not trimmed), ``Units``, ``Totalprice``."""
    _require(df, store_col, units_col, price_col)
    units, dollars = measures(df, units_col, price_col, implied_units, implied_dollars, price_type)
    return df.select(
        _ref(store_col).cast("string").alias("STORE_NUMBER"),
        units.alias("Units"),
        dollars.alias("Totalprice"),
        *_file_column(df),
    )


def to_item_rows(
    df: DataFrame,
    upc_col: str,
    desc_col: str,
    units_col: str,
    price_col: str,
    implied_units: bool = False,
    implied_dollars: bool = False,
    price_type: str = TOTAL_PRICE,
) -> DataFrame:
    """``UPC_CODE``, ``PRODUCT_DESCRIPTION`` (both trimmed, no null description),
    ``UNITS_SOLD``, ``TOTAL_DOLLARS``."""
    _require(df, upc_col, desc_col, units_col, price_col)
    units, dollars = measures(df, units_col, price_col, implied_units, implied_dollars, price_type)
    return df.select(
        _text_key(upc_col).alias("UPC_CODE"),
        F.coalesce(_text_key(desc_col), F.lit("")).alias("PRODUCT_DESCRIPTION"),
        units.alias("UNITS_SOLD"),
        dollars.alias("TOTAL_DOLLARS"),
        *_file_column(df),
    )


def to_upc_rows(
    df: DataFrame,
    upc_col: str,
    units_col: str,
    price_col: str,
    implied_units: bool = False,
    implied_dollars: bool = False,
    price_type: str = TOTAL_PRICE,
) -> DataFrame:
    """``UPC`` (trimmed), ``UNITS_SOLD``, ``TOTAL_DOLLARS``."""
    _require(df, upc_col, units_col, price_col)
    units, dollars = measures(df, units_col, price_col, implied_units, implied_dollars, price_type)
    return df.select(
        _text_key(upc_col).alias("UPC"),
        units.alias("UNITS_SOLD"),
        dollars.alias("TOTAL_DOLLARS"),
        *_file_column(df),
    )


def to_rows(df: DataFrame, level: str, config: FormatConfig) -> DataFrame:
    """Canonical rows of one level. Only stores apply the configured price type;
    item and UPC dollars are the raw prices."""
    scale = dict(implied_units=config.implied_units, implied_dollars=config.implied_dollars)
    if level == "store":
        config.require("store_col", "units_col", "price_col")
        return to_store_rows(
            df, config.store_col, config.units_col, config.price_col,
            price_type=config.price_type, **scale,
        )
    if level == "item":
        config.require("upc_col", "desc_col", "units_col", "price_col")
        return to_item_rows(
            df, config.upc_col, config.desc_col, config.units_col, config.price_col, **scale
        )
    if level == "upc":
        config.require("upc_col", "units_col", "price_col")
        return to_upc_rows(df, config.upc_col, config.units_col, config.price_col, **scale)
    raise ValueError(f"Unknown aggregation level: {level}")


def to_sales_rows(df: DataFrame, config: FormatConfig) -> DataFrame:
    """Everything both levels need from one scan: store, UPC, description, units,
    store dollars (``Totalprice``) and item dollars (``TOTAL_DOLLARS``)."""
    config.require("store_col", "upc_col", "desc_col", "units_col", "price_col")
    _require(df, config.store_col, config.upc_col, config.desc_col, config.units_col, config.price_col)
    units, dollars = measures(
        df, config.units_col, config.price_col, config.implied_units, config.implied_dollars
    )
    parsed = df.select(
        _ref(config.store_col).cast("string").alias("STORE_NUMBER"),
        _text_key(config.upc_col).alias("UPC_CODE"),
        F.coalesce(_text_key(config.desc_col), F.lit("")).alias("PRODUCT_DESCRIPTION"),
        units.alias("Units"),
        dollars.alias("TOTAL_DOLLARS"),
        *_file_column(df),
    )
    return parsed.withColumn(
        "Totalprice", line_total(F.col("Units"), F.col("TOTAL_DOLLARS"), config.price_type)
    )


def bad_measure_count(df: DataFrame, config: FormatConfig) -> Column:
    """Aggregate: rows whose units or price text holds no number."""
    return F.count_if(
        is_bad_measure(_ref(config.units_col)) | is_bad_measure(_ref(config.price_col))
    )
