"""Driver tables as two sides of retail sales, and as raw sales files.

Both sides hold every ``lineitem`` row. The TEST side renames some stores and UPCs,
changes some descriptions and adds a unit to some lines, so that every presence
class and every kind of difference occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posrecon.config import FormatConfig, LayoutField, save_format_config, write_text
from posrecon.shared import scratch_dir

RAW = ["Store", "UPC", "Description", "Units", "Price"]
ROLES = dict(
    store_col="Store", upc_col="UPC", desc_col="Description", units_col="Units", price_col="Price"
)
TABLE_CONFIG = FormatConfig(file_type="delimited", delimiter=",", schema=RAW, **ROLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _raw(line: DataFrame, store, upc, descr, units) -> DataFrame:
    return line.select(
        store.alias("Store"), upc.alias("UPC"), descr.alias("Description"),
        units.alias("Units"), F.col("l_extendedprice").alias("Price"),
        F.date_format("l_shipdate", "yyyy-MM").alias("Month"), F.col("l_linestatus").alias("Status"),
        F.col("l_orderkey").alias("OrderKey"), F.col("l_linenumber").alias("LineNumber"),
        F.col("l_shipdate").alias("ShipDate"),
    )


def _number(name: str, width: int):
    return F.lpad(F.col(name).cast("string"), width, "0")


def bau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(
        table(spark, sf_dir, "lineitem"),
        F.concat(F.lit("S"), _number("l_suppkey", 10)),
        _number("l_partkey", 12),
        F.concat_ws(" ", F.lit("ITEM"), F.col("l_partkey").cast("string"), "l_returnflag"),
        F.col("l_quantity"),
    )


def test(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey")
    renamed = (part % 50 == 0) | ((part % 7 == 0) & (F.col("l_returnflag") == "R"))
    return _raw(
        table(spark, sf_dir, "lineitem"),
        F.concat(F.when(F.col("l_suppkey") % 7 == 5, "N").otherwise("S"), _number("l_suppkey", 10)),
        F.when(part % 11 == 0, F.concat(F.lit("9"), _number("l_partkey", 11)))
        .otherwise(_number("l_partkey", 12)),
        F.concat(
            F.concat_ws(" ", F.lit("ITEM"), part.cast("string"), "l_returnflag"),
            F.when(renamed, " NEW").otherwise(""),
        ),
        F.col("l_quantity") + F.when(part % 9 == 0, 1).otherwise(0),
    )


# --- raw files -------------------------------------------------------------

FIXED_LAYOUT = [
    LayoutField("Store", 0, 12), LayoutField("UPC", 12, 26), LayoutField("Description", 26, 56),
    LayoutField("Units", 56, 62, "numeric"), LayoutField("Price", 62, 76, "numeric"),
]
HEADER_LAYOUT = [LayoutField("Store", 3, 15), LayoutField("Month", 15, 22)]
DETAIL_LAYOUT = [
    LayoutField("UPC", 0, 14), LayoutField("Description", 14, 44),
    LayoutField("Units", 44, 50, "numeric"), LayoutField("Price", 50, 64, "numeric"),
]
TRAILER_LAYOUT = [
    LayoutField("TotalUnits", 3, 19, "numeric"), LayoutField("TotalPrice", 19, 39, "numeric"),
]

CONFIGS = {
    "delimited": TABLE_CONFIG,
    "fixed": FormatConfig(file_type="fixed", layout=FIXED_LAYOUT, **ROLES),
    "records": FormatConfig(
        file_type="multiline", ml_record_types=["D"], schema=RAW, **ROLES
    ),
    "transactions": FormatConfig(
        file_type="multiline", header_prefix="HDR", header_layout=HEADER_LAYOUT,
        detail_layout=DETAIL_LAYOUT, trailer_prefix="TRL", trailer_layout=TRAILER_LAYOUT, **ROLES,
    ),
}

_written: dict[tuple[str, str, str], str] = {}


def _money(name: str):
    return F.format_string("%.2f", F.col(name))


def _padded(width: int, c):
    return F.rpad(c, width, " ")


def raw_files(spark: SparkSession, sf_dir: str, side: str, kind: str) -> str:
    """Write one side's rows as raw files of one format, once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, f"{side}-{kind}")
    if key not in _written:
        rows = {"bau": bau, "test": test}[side](spark, sf_dir)
        path = f"{scratch_dir(spark)}/{side}-{kind}"
        _WRITERS[kind](rows, path)
        _written[key] = path
    return _written[key]


#: Compressed files are read whole, so each has a bounded number of rows.
ROWS_PER_FILE = 1 << 17
COMPRESSED = dict(compression="gzip", maxRecordsPerFile=ROWS_PER_FILE)


def _write_delimited(rows: DataFrame, path: str) -> None:
    rows.select(*RAW).write.options(header=True, **COMPRESSED).csv(path)


def _write_deliveries(rows: DataFrame, path: str) -> None:
    rows.select(*RAW, "Month").write.partitionBy("Month").option("header", True).csv(path)


def _write_fixed(rows: DataFrame, path: str) -> None:
    rows.select(
        F.concat(
            _padded(12, F.col("Store")), F.lpad("UPC", 14, " "), _padded(30, F.col("Description")),
            F.lpad(F.col("Units").cast("long").cast("string"), 6, " "), F.lpad(_money("Price"), 14, " "),
        )
    ).write.options(**COMPRESSED).text(path)


def _write_records(rows: DataFrame, path: str) -> None:
    detail = F.concat_ws(
        "|", F.lit("D"), "Store", "UPC", "Description",
        F.col("Units").cast("long").cast("string"), _money("Price"),
    )
    header = F.concat_ws("|", F.lit("H"), "Store", "Month")
    rows.select(F.explode(F.array(header, detail)).alias("value")).write.text(path)


def _write_transactions(rows: DataFrame, path: str) -> None:
    """One transaction per store and month: header, its details, trailer with totals."""
    keys = ["Store", "Month"]
    detail = F.concat(
        _padded(14, F.col("UPC")), _padded(30, F.col("Description")),
        F.lpad(F.col("Units").cast("long").cast("string"), 6, " "), F.lpad(_money("Price"), 14, " "),
    )
    ends = rows.groupBy(*keys).agg(
        F.sum("Units").cast("long").cast("string").alias("u"),
        F.sum(F.col("Price").cast("decimal(18,2)")).cast("string").alias("p"),
    )
    marks = F.array(
        F.struct(F.lit(0).alias("kind"), F.concat(F.lit("HDR"), _padded(12, F.col("Store")), "Month").alias("value")),
        F.struct(F.lit(2).alias("kind"), F.concat(F.lit("TRL"), F.lpad("u", 16, " "), F.lpad("p", 20, " ")).alias("value")),
    )
    lines = rows.select(*keys, F.lit(1).alias("kind"), detail.alias("value")).unionByName(
        ends.select(*keys, F.explode(marks).alias("m")).select(*keys, "m.*")
    )
    lines.repartition(*keys).sortWithinPartitions(*keys, "kind").select("value").write.text(path)


def _write_mixed(rows: DataFrame, path: str) -> None:
    """Two headers in one folder: one line state in the usual column order, the other
    in reverse order."""
    rows.where(F.col("Status") == "F").select(*RAW).write.option("header", True).csv(path)
    rows.where(F.col("Status") != "F").select(*reversed(RAW)).write.mode("append").option(
        "header", True
    ).csv(path)


BANNER = ["Daily sales export", "all stores"]


def _write_banner(rows: DataFrame, path: str) -> None:
    """Files that begin with two lines of text before the header row."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = F.array(
        *[
            F.struct(F.lit(i).alias("kind"), F.lit(text).alias("value"))
            for i, text in enumerate([*BANNER, ",".join(RAW)])
        ]
    )
    lines = rows.select(
        F.pmod(F.xxhash64(*RAW), F.lit(n)).alias("part"),
        F.lit(len(BANNER) + 1).alias("kind"),
        F.concat_ws(",", "Store", "UPC", "Description", F.col("Units").cast("string"), _money("Price"))
        .alias("value"),
    ).unionByName(
        spark.range(n).select(F.col("id").alias("part"), F.explode(top).alias("t")).select("part", "t.*")
    )
    (
        lines.repartition(n, "part").sortWithinPartitions("part", "kind")
        .select("part", "value").write.partitionBy("part").text(path)
    )


#: What the files with line breaks in their cells add to a description.
SECOND_LINE = '\nsecond "line", with a comma'


def _write_quoted(rows: DataFrame, path: str) -> None:
    """Every third description goes on over a line break, with quotes and a comma."""
    more = F.when(F.substring("UPC", -1, 1).isin("0", "3", "6", "9"), F.lit(SECOND_LINE)).otherwise("")
    rows.withColumn("Description", F.concat("Description", more)).select(*RAW).write.options(
        header=True, escape='"'
    ).csv(path)


PARTS = 4
#: Details of this line number stand between transactions.
ORPHANS = 7


def _write_orphans(rows: DataFrame, path: str) -> None:
    """One trailer per store after a transaction per month, blank lines, and details that belong to none of them.

    The trailer ends all transactions of its store; what follows it before the next header is orphaned. Stores lie in folders
    by part, and a store's lines in one file; many tasks write the files of a part.
    """
    part = F.substring("Store", 2, 20).cast("long") % PARTS
    detail = F.concat(
        _padded(14, F.col("UPC")), _padded(30, F.col("Description")),
        F.lpad(F.col("Units").cast("long").cast("string"), 6, " "), F.lpad(_money("Price"), 14, " "),
    )
    kept = rows.where(F.col("LineNumber") != ORPHANS)
    heads = kept.select("Store", "Month").distinct().select(
        "Store", "Month", F.explode(F.array(
            F.struct(F.lit(0).alias("kind"), F.concat(F.lit("HDR"), _padded(12, F.col("Store")), "Month").alias("value")),
            F.struct(F.lit(1).alias("kind"), F.lit("").alias("value")),
        )).alias("m"),
    ).select("Store", "Month", "m.*")
    ends = kept.groupBy("Store").agg(
        F.sum("Units").cast("long").cast("string").alias("u"), F.sum(F.col("Price").cast("decimal(18,2)")).cast("string").alias("p")
    ).select("Store", F.lit("9").alias("Month"), F.lit(0).alias("kind"), F.concat(F.lit("TRL"), F.lpad("u", 16, " "), F.lpad("p", 20, " ")).alias("value"))
    lines = (
        kept.select("Store", "Month", F.lit(2).alias("kind"), detail.alias("value"))
        .unionByName(heads).unionByName(ends)
        .unionByName(rows.where(F.col("LineNumber") == ORPHANS).select("Store", F.lit("9").alias("Month"), F.lit(1).alias("kind"), detail.alias("value")))
        .withColumn("part", part)
    )
    (
        lines.repartition("part", "Store").sortWithinPartitions("part", "Store", "Month", "kind")
        .select("part", "value").write.partitionBy("part").text(path)
    )


NUMBERED_PARTS = 5


def _write_numbered(rows: DataFrame, path: str) -> None:
    """Lines of order and line number in order, one file per ``part``."""
    lines = rows.select(
        (F.col("OrderKey") % NUMBERED_PARTS).alias("part"), "OrderKey", "LineNumber",
        F.concat_ws("|", "OrderKey", "LineNumber").alias("value"),
    )
    (
        lines.repartition("part").sortWithinPartitions("part", "OrderKey", "LineNumber")
        .select("part", "value").write.partitionBy("part").text(path)
    )


#: Lines that travel as one row once they are in order.
CHUNK_BITS = 10
CHUNK = 1 << CHUNK_BITS
#: Four blanks as one character, and the marks of that character and of its mark.
_SHORT = (("\x02", "\x02b"), ("\x01", "\x02a"), ("    ", "\x01"))


def _replaced(c, pairs):
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _write_by_part(rows: DataFrame, lines: DataFrame, path: str, *first: str) -> None:
    """One file per ``part`` in the order of ``first``, order, line number, kind and value (a null order has no part).

    Lines are sorted in ranges of orders by many tasks, and joined to texts of up to ``CHUNK`` lines there. Only these move,
    with their blanks shortened, to the task that writes the file of their part, so it sorts texts, not lines.
    """
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.min("OrderKey").alias("a"), F.max("OrderKey").alias("b")).first()
    # Ranges and groups of lines that are near in order; its width changes their sizes only, never the result.
    width = max(1, int(((seen["b"] or 0) - (seen["a"] or 0) + 1) * CHUNK // max(1, seen["n"])))
    near = F.when(F.col("kind") >= 0, F.floor(F.col("OrderKey") / F.lit(width)))
    order = ["part", "near", *first, "OrderKey", "LineNumber", "kind", "value"]
    placed = (
        lines.withColumns({"part": F.col("OrderKey") % NUMBERED_PARTS, "near": near, "value": F.coalesce("value", F.lit(""))})
        .repartitionByRange("part", "near").sortWithinPartitions(*order)
        .select("part", "near", "value", F.monotonically_increasing_id().alias("place"))
    )
    texts = placed.groupBy("part", "near", F.shiftright("place", CHUNK_BITS).alias("chunk")).agg(
        _replaced(F.array_join(F.sort_array(F.collect_list(F.struct("place", "value")))["value"], "\n"), _SHORT).alias("value")
    )
    # The remainder of a negative order is negative; each part has a task of its own.
    own = F.coalesce(F.col("part") + NUMBERED_PARTS, F.lit(0)).cast("int")
    (
        texts.repartitionById(2 * NUMBERED_PARTS, own).sortWithinPartitions("part", "near", "chunk")
        .select("part", _replaced(F.col("value"), [(new, old) for old, new in reversed(_SHORT)]).alias("value"))
        .write.partitionBy("part").text(path)
    )


def _ordered_fixed(rows: DataFrame, path: str) -> None:
    units = F.col("Units").cast("long").cast("string")
    line = F.concat(
        _padded(12, F.col("Store")), F.lpad("UPC", 14, " "), _padded(30, F.col("Description")), F.lpad(units, 6, " "),
        F.lpad(_money("Price"), 14, " "),
    )
    _write_by_part(rows, rows.select("OrderKey", "LineNumber", F.lit(0).alias("kind"), line.alias("value")), path)


def _ordered_records(rows: DataFrame, path: str) -> None:
    units = F.col("Units").cast("long").cast("string")
    record = F.concat_ws("|", F.lit("D"), "Store", "UPC", "Description", units, _money("Price"))
    mark = F.concat_ws("|", F.lit("H"), "Store", "Month")
    one = lambda kind, line: F.struct(F.lit(kind).alias("kind"), line.alias("value"))
    both = F.explode(F.array(one(0, mark), one(1, record))).alias("m")
    _write_by_part(rows, rows.select("OrderKey", "LineNumber", both).select("OrderKey", "LineNumber", "m.*"), path)


def _ordered_transactions(rows: DataFrame, path: str) -> None:
    """Transactions are orders here: a header with the order, its lines, a trailer with its totals."""
    units = F.col("Units").cast("long").cast("string")
    detail = F.concat(_padded(14, F.col("UPC")), _padded(30, F.col("Description")), F.lpad(units, 6, " "), F.lpad(_money("Price"), 14, " "))
    ends = rows.groupBy("OrderKey").agg(
        F.sum("Units").cast("long").cast("string").alias("u"), F.sum(F.col("Price").cast("decimal(18,2)")).cast("string").alias("p")
    ).select("OrderKey", F.explode(F.array(
        F.struct(F.lit(0).alias("LineNumber"), F.concat(F.lit("HDR"), F.rpad(F.col("OrderKey").cast("string"), 12, " "), F.lit("2000-01")).alias("value")),
        F.struct(F.lit(99).alias("LineNumber"), F.concat(F.lit("TRL"), F.lpad("u", 16, " "), F.lpad("p", 20, " ")).alias("value")),
    )).alias("m")).select("OrderKey", "m.*")
    lines = rows.select("OrderKey", F.col("LineNumber").cast("int").alias("LineNumber"), detail.alias("value"))
    _write_by_part(rows, lines.unionByName(ends).withColumn("kind", F.lit(0)), path)


def _ordered_delimited(rows: DataFrame, path: str) -> None:
    units = F.col("Units").cast("long").cast("string")
    line = F.concat_ws(",", "Store", "UPC", "Description", units, _money("Price"))
    lines = rows.select("OrderKey", "LineNumber", F.lit(0).alias("kind"), line.alias("value"))
    header = rows.sparkSession.range(NUMBERED_PARTS).select(
        F.col("id").alias("OrderKey"), F.lit(-1).alias("LineNumber"), F.lit(-1).alias("kind"), F.lit(",".join(RAW)).alias("value")
    )
    _write_by_part(rows, lines.unionByName(header), path, "kind")


def _write_hard(rows: DataFrame, path: str) -> None:
    """Delimited files as they should not be, in code page 1252: by line number a row lacks its price, has more cells than
    the header, has no store, follows a blank line, or has blanks around its UPC."""
    line = F.col("LineNumber")
    cells = lambda *c: F.concat_ws(",", *c)
    text = F.concat(F.lit("CAF\xc9 \u20ac "), F.col("Description"))
    units = F.col("Units").cast("long").cast("string")
    whole = cells(F.coalesce("Store", F.lit("")), "UPC", text, units, _money("Price"))
    value = (
        F.when(line == 1, cells("Store", "UPC", text, units))
        .when(line == 2, F.concat(whole, F.lit(",one,more")))
        .when(line == 3, cells(F.lit(""), "UPC", text, units, _money("Price")))
        .when(line == 5, cells("Store", F.concat(F.lit(" "), "UPC", F.lit("  ")), text, units, _money("Price")))
        .otherwise(whole)
    )
    lines = F.explode(F.when(line == 4, F.array(F.lit(""), value)).otherwise(F.array(value)))
    # One column named like the header, written without quotes; the sign of the euro has a byte of its own.
    bytes_ = F.translate("value", "\u20ac", "\x80")
    rows.select(lines.alias("value")).select(bytes_.alias(",".join(RAW))).write.options(
        header=True, encoding="ISO-8859-1", quote="\x00", sep="\x01", emptyValue=""
    ).csv(path)


def _write_dates(rows: DataFrame, path: str) -> None:
    """Fixed-width lines with a six-digit date, and blank lines, which are empty records."""
    line = F.concat(F.date_format("ShipDate", "yyMMdd"), F.lpad(F.col("LineNumber").cast("string"), 4, "0"))
    blank = F.col("LineNumber") == 7
    rows.select(F.explode(F.when(blank, F.array(line, F.lit(""))).otherwise(F.array(line))).alias("value")).write.text(path)


DATE_LAYOUT = [LayoutField("Day", 0, 6, "date"), LayoutField("Line", 6, 10, "numeric")]

#: Three layouts of the same sales, one folder each; ``LAYOUTS`` also has each one's saved options.
LAYOUTS = {
    "plain": (FIXED_LAYOUT, {}),
    "implied": (
        [LayoutField("qty", 0, 9, "numeric"), LayoutField("amount", 9, 21, "numeric"), LayoutField("shop", 21, 33),
         LayoutField("code", 33, 47), LayoutField("text", 47, 77)],
        dict(implied_units=True, implied_dollars=True, store_col="shop", upc_col="code", desc_col="text", units_col="qty", price_col="amount"),
    ),
    "marked": (
        [LayoutField("Kind", 0, 1), LayoutField("Description", 1, 31), LayoutField("Store", 31, 43), LayoutField("Price", 43, 57),
         LayoutField("UPC", 57, 71), LayoutField("Units", 71, 77)],
        dict(record_type="R"),
    ),
}


def _write_layouts(rows: DataFrame, path: str) -> None:
    """Each third of the rows in a layout of its own, beside saved configurations and layout files."""
    spark = rows.sparkSession
    whole = lambda name, width, factor=1: F.lpad((F.col(name) * factor).cast("decimal(20,0)").cast("string"), width, "0")
    units = F.lpad(F.col("Units").cast("long").cast("string"), 6, " ")
    text = F.col("Description")
    lines = {
        "plain": F.concat(_padded(12, F.col("Store")), F.lpad("UPC", 14, " "), _padded(30, text), units, F.lpad(_money("Price"), 14, " ")),
        "implied": F.concat(whole("Units", 9, 100), whole("Price", 12, 100), _padded(12, F.col("Store")), F.lpad("UPC", 14, " "), _padded(30, text)),
        "marked": F.concat(F.lit("R"), _padded(30, text), _padded(12, F.col("Store")), F.lpad(_money("Price"), 14, " "), F.lpad("UPC", 14, " "), units),
    }
    for k, (name, (layout, options)) in enumerate(LAYOUTS.items()):
        table = [(f.start + 1, f.length, f.field, f.type) for f in layout]
        header = ("FROM,Length,field,Type", "From,LENGTH,Field,type", "from,length,Field,Type")[k]
        write_text("\n".join([header, *(",".join(map(str, r)) for r in table)]) + "\n", f"{path}/configs/layouts/{name}.csv", spark)
        config = FormatConfig(**{**ROLES, **options}, name=name, file_type="fixed", layout_file=f"layouts/{name}.csv")
        save_format_config(config, f"{path}/configs/{name}.json", spark)
        mine = rows.where(F.col("LineNumber") % 3 == k).select(lines[name].alias("value"))
        if name == "marked":
            # Every line is followed by one of another kind.
            mine = mine.select(F.explode(F.array("value", F.lit("Xnothing to read"))).alias("value"))
        mine.write.text(f"{path}/data/{name}")


_WRITERS = {
    "layouts": _write_layouts,
    "hard": _write_hard,
    "dates": _write_dates,
    "ordered_fixed": _ordered_fixed,
    "ordered_records": _ordered_records,
    "ordered_transactions": _ordered_transactions,
    "ordered_delimited": _ordered_delimited,
    "quoted": _write_quoted,
    "orphans": _write_orphans,
    "numbered": _write_numbered,
    "mixed": _write_mixed,
    "banner": _write_banner,
    "delimited": _write_delimited,
    "deliveries": _write_deliveries,
    "fixed": _write_fixed,
    "records": _write_records,
    "transactions": _write_transactions,
}
