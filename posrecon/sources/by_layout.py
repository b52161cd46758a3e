"""Fixed-width files of many layouts in one scan.

Configurations and layouts are data: a table of saved configurations (JSON) joined to a table of layouts (CSV,
one row per field, gathered as arrays of name, start, length and type). A file belongs to the configuration that its path
names. Each line is cut by the positions of its own configuration, so the number of layouts changes
neither the plan nor the number of scans.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posrecon.config import TOTAL_PRICE, UNIT_PRICE
from posrecon.functions.measures import parse_measure, safe_numeric
from posrecon.functions.text import decode_bytes, strip, typed
from posrecon.shared import stored
from posrecon.sources.delimited import read_delimited
from posrecon.sources.lines import FILE, LINE_NO, VALUE, as_paths, number_lines, read_lines

ROLES = ("store", "upc", "desc", "units", "price")
FIELDS = "array<struct<field:string,start:int,length:int,type:string>>"
#: Configurations are sent to every task up to this number (a few hundred bytes each).
BROADCAST_CONFIGS = 100_000

_SAVED = (
    "name string, file_type string, encoding string, start_line int, record_type string, layout_file string, "
    "store_col string, upc_col string, desc_col string, units_col string, price_col string, price_type string, "
    "implied_dollars boolean, implied_units boolean"
)


def _plain(path: Column) -> Column:
    """A path without the scheme of local files and without percent codes."""
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(F.coalesce(decoded, path), "^file:/+", "/")


def load_layouts(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """``layout_file`` and its ``fields`` for every layout CSV (From, Length, Field, optional Type; From counts from 1)."""
    table = read_delimited(spark, paths, ",", encoding="utf-8", mixed_headers=True, with_file=True)
    table = table.toDF(*[c if c == FILE else c.strip().lower() for c in table.columns])
    kind = F.coalesce(F.nullif(F.lower(strip(F.col("type"))), F.lit("")), F.lit("text")) if "type" in table.columns else F.lit("text")
    field = F.struct(
        strip(F.col("field")).alias("field"), (strip(F.col("from")).cast("int") - 1).alias("start"),
        strip(F.col("length")).cast("int").alias("length"), kind.alias("type"),
    )
    # A layout has as many fields as a line has columns.
    return table.groupBy(_plain(F.col(FILE)).alias("layout_file")).agg(F.collect_list(field).cast(FIELDS).alias("fields"))


def load_configs(spark: SparkSession, paths: str | Iterable[str], layouts: DataFrame) -> DataFrame:
    """Saved fixed-width configurations with the fields of their layout; one that names no known layout is an error.

    Layout paths are relative to the configuration's folder.
    """
    saved = spark.read.schema(_SAVED).option("multiLine", True).json(as_paths(paths)).select("*", F.col("_metadata.file_path").alias(FILE))
    folder = F.regexp_replace(_plain(F.col(FILE)), "/[^/]*$", "")
    given = F.regexp_replace(F.col("layout_file"), r"^\./", "")
    absolute = given.rlike("^/|^[a-zA-Z][a-zA-Z0-9+.-]*:/")
    full = F.when(absolute, _plain(given)).otherwise(F.concat(folder, F.lit("/"), given))
    joined = saved.where(F.col("file_type") == "fixed").withColumn("layout_file", full).join(layouts, "layout_file", "left")
    checked = F.when(F.col("fields").isNotNull(), F.col("fields")).otherwise(
        F.raise_error(F.concat(F.lit("no layout for configuration "), F.coalesce("name", F.lit("?")))).cast(FIELDS)
    )
    return joined.drop(FILE).withColumn("fields", checked)


def _role(role: str) -> Column:
    """The field that plays a role; one that the layout lacks is an error."""
    wanted = F.col(f"{role}_col")
    found = F.get(F.filter("fields", lambda f: f["field"] == wanted), F.lit(0))
    missing = F.raise_error(F.concat(F.lit(f"{role} column is not in the layout of "), F.coalesce("name", F.lit("?"))))
    return F.when(found.isNotNull(), found).otherwise(missing.cast("struct<field:string,start:int,length:int,type:string>"))


def _cut(role: str) -> Column:
    field = F.col(role)
    raw = strip(F.substr(F.col(VALUE), field["start"] + 1, field["length"]))
    return F.when(field["type"] == "numeric", typed(raw, "numeric")).when(field["type"] == "date", typed(raw, "date")).otherwise(raw)


def read_by_layout(spark: SparkSession, paths: str | Iterable[str], configs: DataFrame, name_of: Column) -> DataFrame:
    """Role columns ``store``, ``upc``, ``desc``, ``units`` and ``price`` as text, the configuration's ``name``, its
    measure options and ``source_file``.

    ``name_of`` derives the name of a file's configuration from ``source_file``; a file without one, and a name that
    two configurations share, stop the job.
    """
    names = configs.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    unique = F.when(F.col("n") == 1, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("two configurations are named "), F.col("name"))).cast("string"))
    known = stored(
        configs.join(names.select(F.col("name"), unique.alias("__unique")), "name").where(F.col("__unique").isNotNull()).select(
            "name", F.coalesce("encoding", F.lit("cp1252")).alias("encoding"), F.coalesce("start_line", F.lit(0)).alias("start_line"),
            F.coalesce("record_type", F.lit("")).alias("record_type"),
            F.coalesce("price_type", F.lit(TOTAL_PRICE)).alias("price_type"),
            F.coalesce("implied_units", F.lit(False)).alias("implied_units"),
            F.coalesce("implied_dollars", F.lit(False)).alias("implied_dollars"),
            *[_role(r).alias(r) for r in ROLES],
        )
    )
    n, skip = known.agg(F.count(F.lit(1)), F.max("start_line")).first()
    lines = read_lines(spark, paths, "latin-1", ordered=bool(skip), with_file=True)
    if skip:
        lines = number_lines(lines)
    lines = lines.withColumn("name", name_of)
    joined = lines.join(F.broadcast(known) if n <= BROADCAST_CONFIGS else known, "name", "left")
    joined = joined.where(
        F.when(F.col("record_type").isNotNull(), True).otherwise(
            F.raise_error(F.concat(F.lit("no configuration for "), F.col(FILE))).cast("boolean")
        )
    )
    if skip:
        joined = joined.where(F.col(LINE_NO) >= F.coalesce("start_line", F.lit(0)))
    raw = F.encode(VALUE, "ISO-8859-1")
    utf8 = F.lower("encoding").isin("utf-8", "utf8", "utf8-lossy")
    text = F.when(utf8, decode_bytes(raw, "utf-8")).otherwise(decode_bytes(raw, "cp1252"))
    decoded = joined.withColumn(VALUE, F.when(F.length(VALUE) == F.octet_length(VALUE), F.col(VALUE)).otherwise(text))
    # Conditions that hold for null, so that a line without a configuration is not dropped before it is an error.
    kept = decoded.where(F.startswith(F.col(VALUE), F.coalesce("record_type", F.lit(""))))
    return kept.select(
        *[_cut(r).alias(r) for r in ROLES], "name", "price_type", "implied_units", "implied_dollars", FILE
    )


def sales_rows_by_layout(rows: DataFrame) -> DataFrame:
    """Canonical sales rows (as ``to_sales_rows``), each by the measure options of its own configuration."""
    hundredth = lambda c, implied: F.when(F.col(implied), c / 100).otherwise(c)
    units = hundredth(safe_numeric("units"), "implied_units")
    dollars = hundredth(safe_numeric("price"), "implied_dollars")
    parsed = rows.select(
        F.col("store").alias("STORE_NUMBER"), F.col("upc").alias("UPC_CODE"),
        F.coalesce("desc", F.lit("")).alias("PRODUCT_DESCRIPTION"), units.alias("Units"), dollars.alias("TOTAL_DOLLARS"),
        (F.col("price_type") == UNIT_PRICE).alias("__unit"), "name", FILE,
        (parse_measure("units").isNull() | parse_measure("price").isNull()).alias("bad_measure"),
    )
    total = F.when(F.col("__unit"), F.col("Units") * F.col("TOTAL_DOLLARS")).otherwise(F.col("TOTAL_DOLLARS"))
    return parsed.withColumn("Totalprice", total).drop("__unit")
