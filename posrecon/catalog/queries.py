"""Registered queries: name -> function of (spark, folder of the tables)."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from posrecon.catalog import sides
from posrecon.catalog.sides import CONFIGS, TABLE_CONFIG, raw_files, table
from posrecon.config import UNIT_PRICE, ValidationRule
from posrecon.functions.measures import exact_sum, is_bad_measure, safe_numeric
from posrecon.functions.text import decode_bytes, delimiter_count, strip
from posrecon.operators import audit as au
from posrecon.operators import compare as cmp
from posrecon.operators import review as rv
from posrecon.operators import stores as st
from posrecon.operators import summarize as sm
from posrecon.operators.canonical import to_item_rows, to_rows, to_sales_rows
from posrecon.plans.config_audit import config_errors
from posrecon.plans.profile import profile_files
from posrecon.plans.history import last_runs, record_run
from posrecon.plans.item_audit import item_audit
from posrecon.plans.mapping import check_mapping
from posrecon.plans.reconcile import RunResult, onboard, reconcile
from posrecon.shared import scratch_dir, stored
from posrecon.sources.by_layout import load_configs, load_layouts, read_by_layout, sales_rows_by_layout
from posrecon.sources.delimited import list_files, read_delimited
from posrecon.sources.dispatch import read_pos
from posrecon.sources.fixed import read_fixed_width
from posrecon.sources.lines import FILE, LINE_NO, number_lines, read_lines
from posrecon.sources.preview import preview_raw, preview_records, preview_transactions
from posrecon.sources.sinks import write_report
from posrecon.sources.transactions import transaction_counts
from posrecon.sources.tables import read_side_parquet, read_store_list
from posrecon.streaming.landing import stream_into, stream_summary
from posrecon.streaming.summary_table import SummaryTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _names(df: DataFrame, **names: str) -> DataFrame:
    """Keep and rename columns: ``new="old"``."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in names.items()])


def _level(df: DataFrame, level: str, config=TABLE_CONFIG, exact: bool | int = True) -> DataFrame:
    return sm.aggregate(df, level, config, exact=exact, ordered=False)


_STORE = dict(store="STORE_NUMBER", units="Units", dollars="Totalprice")
_ITEM = dict(
    upc="UPC_CODE", descr="PRODUCT_DESCRIPTION", units="UNITS_SOLD", dollars="TOTAL_DOLLARS"
)


# --- summaries -------------------------------------------------------------


@register
def store_summary(spark, sf):
    return _names(_level(sides.bau(spark, sf), "store"), **_STORE)


@register
def item_summary_rows(spark, sf):
    return _names(_level(sides.bau(spark, sf), "item"), **_ITEM)


@register
def upc_summary(spark, sf):
    return _names(
        _level(sides.bau(spark, sf), "upc"), upc="UPC", units="UNITS_SOLD", dollars="TOTAL_DOLLARS"
    )


@register
def store_unit_price_implied(spark, sf):
    config = TABLE_CONFIG.with_(price_type=UNIT_PRICE, implied_units=True, implied_dollars=True)
    return _names(_level(sides.bau(spark, sf), "store", config, exact=6), **_STORE)


@register
def measure_parsing(spark, sf):
    """Prices dressed up as the text a retailer sends, parsed back."""
    price = F.format_string("%.2f", F.col("l_extendedprice"))
    text = (
        F.when(F.col("l_linenumber") % 5 == 0, F.concat(F.lit("$"), price))
        .when(F.col("l_linenumber") % 5 == 1, F.concat(F.lit("("), price, F.lit(")")))
        .when(F.col("l_linenumber") % 5 == 2, F.concat(price, F.lit(" EA")))
        .when(F.col("l_linenumber") % 5 == 3, F.lit("N/A"))
        .otherwise(price)
    )
    return (
        table(spark, sf, "lineitem")
        .select("l_returnflag", "l_linenumber", text.alias("price_text"))
        .select(
            "l_returnflag", "l_linenumber",
            safe_numeric("price_text").alias("price"), is_bad_measure("price_text").alias("bad"),
        )
        .groupBy("l_returnflag", "l_linenumber")
        .agg(
            exact_sum("price").alias("price"),
            F.count_if("bad").alias("bad_measures"),
            F.count(F.lit(1)).alias("n"),
        )
    )


@register
def delimiter_counts(spark, sf):
    """Unquoted delimiters in every whole text of ``conversations``."""
    return table(spark, sf, "conversations").select(
        "conv_id", "turn",
        *[
            delimiter_count(F.col("text"), d).cast("long").alias(n)
            for d, n in ((",", "commas"), ("|", "pipes"), ("\t", "tabs"), (";", "semicolons"))
        ],
    )


@register
def document_text(spark, sf):
    """Whole documents decoded from bytes and stripped."""
    text = decode_bytes(F.encode("text", "UTF-8"), "auto")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.length(text).cast("long").alias("n"),
        F.length(strip(text)).cast("long").alias("n_stripped"),
    )


@register
def merge_summaries(spark, sf):
    """Summaries of the two line states added together."""
    rows = sides.bau(spark, sf)
    parts = [_level(rows.where(F.col("Status") == s), "store") for s in ("F", "O")]
    return _names(sm.merge_summaries(parts, "store", exact=True), **_STORE)


@register
def rule_aggregate(spark, sf):
    rule = ValidationRule(
        required_columns=["STORE_NUMBER", "UPC_CODE"],
        group_by_columns=["STORE_NUMBER", "Month"],
        aggregation_columns=["UNITS_SOLD"],
    )
    rows = sides.bau(spark, sf).withColumnsRenamed(
        {"Store": "STORE_NUMBER", "UPC": "UPC_CODE", "Units": "UNITS_SOLD"}
    )
    return _names(
        sm.aggregate_by_rule(rows, rule, "item", exact=True),
        store="STORE_NUMBER", month="Month", units="UNITS_SOLD",
    )


@register
def rules_aggregate(spark, sf):
    """Three rules over one scan: by store and month, by UPC, and by month with both sums."""
    rules = {
        "store_month": ValidationRule(group_by_columns=["STORE_NUMBER", "Month"], aggregation_columns=["UNITS_SOLD"]),
        "upc": ValidationRule(group_by_columns=["UPC_CODE"], aggregation_columns=["TOTAL_DOLLARS"]),
        "month": ValidationRule(required_columns=["STORE_NUMBER"], group_by_columns=["Month"]),
    }
    rows = sides.bau(spark, sf).withColumnsRenamed(
        {"Store": "STORE_NUMBER", "UPC": "UPC_CODE", "Units": "UNITS_SOLD", "Price": "TOTAL_DOLLARS"}
    )
    return _names(
        sm.aggregate_by_rules(rows, rules, "item", exact=True),
        rule="rule", store="STORE_NUMBER", month="Month", upc="UPC_CODE", units="UNITS_SOLD", dollars="TOTAL_DOLLARS",
    )


# --- comparisons -----------------------------------------------------------


def _store_diffs(spark, sf) -> DataFrame:
    return cmp.store_validation(
        to_rows(sides.bau(spark, sf), "store", TABLE_CONFIG),
        to_rows(sides.test(spark, sf), "store", TABLE_CONFIG),
        exact=True, ordered=False,
    )


def _item_comparison(spark, sf) -> DataFrame:
    return cmp.item_validation(
        to_rows(sides.bau(spark, sf), "item", TABLE_CONFIG),
        to_rows(sides.test(spark, sf), "item", TABLE_CONFIG),
        exact=True,
    )[0]


def _store_view(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("STORE_NUMBER").alias("store"),
        F.col("Units_Prod").alias("units_prod"), F.col("Totalprice_Prod").alias("dollars_prod"),
        F.col("Units_Test").alias("units_test"), F.col("Totalprice_Test").alias("dollars_test"),
        F.round("Units_Diff", 4).alias("units_diff"), F.round("Sales_Diff", 4).alias("sales_diff"),
        F.round("`Units_Diff_%`", 6).alias("units_diff_pct"),
        F.round("`Sales_Diff_%`", 6).alias("sales_diff_pct"),
    )


@register
def store_validation(spark, sf):
    return _store_view(_store_diffs(spark, sf))


def _item_view(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("UPC_CODE").alias("upc"), F.col("PRODUCT_DESCRIPTION").alias("descr"),
        F.col("BAU Units").alias("bau_units"), F.col("BAU Dollars").alias("bau_dollars"),
        F.col("TEST Units").alias("test_units"), F.col("TEST Dollars").alias("test_dollars"),
        F.col("Present In").alias("present_in"),
        F.round("Units Difference", 4).alias("units_diff"),
        F.round("Dollar Difference", 4).alias("dollar_diff"),
        F.round("`Unit % Difference`", 6).alias("unit_pct"),
        F.round("`Dollar % Difference`", 6).alias("dollar_pct"),
    )


@register
def item_validation(spark, sf):
    return _item_view(_item_comparison(spark, sf))


@register
def item_validation_named(spark, sf):
    """Descriptions from ``part``; sums form before the join, so a hot part is one row."""
    names = table(spark, sf, "part").select(F.col("p_partkey"), F.col("p_name"))

    def side(extra) -> DataFrame:
        sums = (
            table(spark, sf, "lineitem")
            .groupBy("l_partkey")
            .agg(
                exact_sum(F.col("l_quantity") + extra).alias("u"),
                exact_sum("l_extendedprice").alias("p"),
            )
        )
        return sums.join(names, F.col("l_partkey") == F.col("p_partkey")).select(
            F.lpad(F.col("l_partkey").cast("string"), 12, "0").alias("UPC"),
            F.col("p_name").alias("Description"),
            F.col("u").alias("Units"), F.col("p").alias("Price"),
        )

    args = ("UPC", "Description", "Units", "Price")
    comparison, _ = cmp.item_validation(
        to_item_rows(side(F.lit(0)), *args),
        to_item_rows(side(F.when(F.col("l_partkey") % 9 == 0, 1).otherwise(0)), *args),
        exact=True,
    )
    return _item_view(comparison)


def _presence_view(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("Present In").alias("present_in"),
        F.round("Units Difference", 2).alias("units_diff"),
        F.round("Dollar Difference", 2).alias("dollar_diff"),
    )


@register
def item_presence_summary(spark, sf):
    return _presence_view(cmp.item_summary(_item_comparison(spark, sf), ordered=False))


@register
def store_tolerance(spark, sf):
    df = cmp.apply_tolerance(_store_diffs(spark, sf), "Units_Diff_%", 1.0)
    return df.select(
        F.col("STORE_NUMBER").alias("store"),
        F.round("`Units_Diff_%`", 6).alias("units_diff_pct"), F.col("Status").alias("status"),
    )


@register
def store_ranked(spark, sf):
    df = cmp.rank_by_diff(_store_diffs(spark, sf), "Units_Diff")
    return _names(df, store="STORE_NUMBER", units_diff="Units_Diff", rank="Rank")


@register
def item_ranked(spark, sf):
    """Most items tie at a zero difference: one value holds most rows."""
    df = cmp.rank_by_diff(_item_comparison(spark, sf), "Units Difference", ascending=True)
    return _names(
        df, upc="UPC_CODE", descr="PRODUCT_DESCRIPTION", units_diff="Units Difference", rank="Rank"
    )


@register
def store_top_k(spark, sf):
    df = cmp.top_by_diff(_store_diffs(spark, sf), 10, "Units_Diff", tiebreak=["STORE_NUMBER"])
    return _names(df, store="STORE_NUMBER", units_diff="Units_Diff")


@register
def store_sorted(spark, sf):
    df = cmp.sort_by_diff(_store_diffs(spark, sf), "Units_Diff", tiebreak=["STORE_NUMBER"])
    return _names(df, store="STORE_NUMBER", units_diff="Units_Diff")


def _stores(spark, sf) -> tuple[DataFrame, DataFrame]:
    return tuple(
        to_rows(side(spark, sf), "store", TABLE_CONFIG).select("STORE_NUMBER")
        for side in (sides.bau, sides.test)
    )


@register
def store_list_compare(spark, sf):
    return st.store_list_diff(*_stores(spark, sf))


@register
def store_list_text(spark, sf):
    return st.store_list_text(st.store_list_diff(*_stores(spark, sf)))


# --- raw files -------------------------------------------------------------


def _from_files(spark, sf, kind: str, level: str) -> DataFrame:
    config = CONFIGS[kind]
    return _level(read_pos(spark, raw_files(spark, sf, "bau", kind), config), level, config)


@register
def read_delimited_store(spark, sf):
    return _names(_from_files(spark, sf, "delimited", "store"), **_STORE)


@register
def read_delimited_item(spark, sf):
    return _names(_from_files(spark, sf, "delimited", "item"), **_ITEM)


@register
def read_fixed_width_item(spark, sf):
    return _names(_from_files(spark, sf, "fixed", "item"), **_ITEM)


def _hard(spark, sf, **options) -> DataFrame:
    config = TABLE_CONFIG.with_(**options)
    return read_pos(spark, raw_files(spark, sf, "bau", "hard"), config)


@register
def read_hard_item(spark, sf):
    """Code page 1252, short and long rows, blank lines, blanks around keys."""
    return _names(_level(_hard(spark, sf, pad_ragged=True), "item"), **_ITEM)


@register
def read_hard_store(spark, sf):
    """Rows without a store are a group of their own."""
    return _names(_level(_hard(spark, sf), "store"), **_STORE)


@register
def read_fixed_dates(spark, sf):
    """Six-digit dates in fixed-width files; blank lines are records with empty fields and zeros."""
    df = read_fixed_width(spark, raw_files(spark, sf, "bau", "dates"), sides.DATE_LAYOUT)
    return df.groupBy(F.col("Day").alias("day"), F.col("Line").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@register
def run_history(spark, sf):
    """One recorded run per line number, with its counts; the latest five."""
    path = f"{scratch_dir(spark)}/history"
    counts = table(spark, sf, "lineitem").groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("failed")
    )
    for r in counts.collect():  # seven rows at most: the line numbers of an order
        record_run(
            spark, path, 1, r["n"], r["n"] / 8, rows_failed=r["failed"],
            timestamp=datetime.datetime(2024, 1, r["l_linenumber"]),
        )
    return last_runs(spark, path, 5).select(
        F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "files_processed", "rows_processed", "execution_time", "rows_failed"
    )


@register
def read_layouts_item(spark, sf):
    """Files of three layouts in one scan, each by its saved configuration and layout file."""
    path = raw_files(spark, sf, "bau", "layouts")
    configs = load_configs(spark, f"{path}/configs/*.json", load_layouts(spark, f"{path}/configs/layouts"))
    rows = sales_rows_by_layout(read_by_layout(spark, f"{path}/data/*", configs, F.element_at(F.split(FILE, "/"), -2)))
    sums = sm.summarize(rows, ["name", "UPC_CODE", "PRODUCT_DESCRIPTION"], ["Units", "TOTAL_DOLLARS"], exact=True)
    return _names(sums, layout="name", upc="UPC_CODE", descr="PRODUCT_DESCRIPTION", units="Units", dollars="TOTAL_DOLLARS")


@register
def read_records_store(spark, sf):
    return _names(_from_files(spark, sf, "records", "store"), **_STORE)


@register
def read_transactions_store(spark, sf):
    """Header fields carried to details: store totals without looking at trailers."""
    config = CONFIGS["transactions"].with_(trailer_layout=None)
    df = read_pos(spark, raw_files(spark, sf, "bau", "transactions"), config)
    return _names(_level(df, "store", config), **_STORE)


@register
def read_transactions_trailer(spark, sf):
    """Details beside the totals their trailer states."""
    df = read_pos(spark, raw_files(spark, sf, "bau", "transactions"), CONFIGS["transactions"])
    return df.groupBy(
        F.col("Store").alias("store"), F.col("Month").alias("month"),
        safe_numeric("TotalUnits").alias("trailer_units"),
        safe_numeric("TotalPrice").alias("trailer_dollars"),
    ).agg(
        F.count(F.lit(1)).alias("details"),
        exact_sum(safe_numeric("Units")).alias("units"),
        exact_sum(safe_numeric("Price")).alias("dollars"),
    )


@register
def read_transactions_orphans(spark, sf):
    """Several transactions under one trailer, blank lines, and details between a trailer and the next header."""
    df = read_pos(spark, raw_files(spark, sf, "bau", "orphans"), CONFIGS["transactions"])
    return df.groupBy(
        F.col("Store").alias("store"), safe_numeric("TotalUnits").alias("trailer_units"), safe_numeric("TotalPrice").alias("trailer_dollars")
    ).agg(
        F.count(F.lit(1)).alias("details"), F.count_distinct("Month").alias("months"),
        exact_sum(safe_numeric("Units")).alias("units"), exact_sum(safe_numeric("Price")).alias("dollars"),
    )


@register
def transaction_orphans(spark, sf):
    """Details and orphans over all files, counted without moving lines."""
    counts = transaction_counts(spark, raw_files(spark, sf, "bau", "orphans"), "HDR", "TRL")
    return counts.agg(F.sum("details").alias("details"), F.sum("orphans").alias("orphans"))


@register
def file_review(spark, sf):
    """One row per delivery folder (a month's files)."""
    path = raw_files(spark, sf, "bau", "deliveries")
    delivery = F.regexp_extract(FILE, "Month=([^/]+)", 1)
    raw = read_delimited(spark, path, ",", with_file=True).withColumn(FILE, delivery)
    files = list_files(spark, path).select(delivery.alias(FILE)).distinct()
    return rv.file_review(rv.review_rows(raw, TABLE_CONFIG), files, exact=True)


@register
def file_review_consolidated(spark, sf):
    rows = sides.bau(spark, sf)
    return rv.review_from_summaries(
        _level(rows, "store"), _level(rows, "upc"), ["a.csv", "b.csv"]
    ).withColumn("total_units", F.round("total_units", 2))


# --- item audit ------------------------------------------------------------


_AUDIT_NAMES = {"UPC": "UPC_CODE", "Description": "PRODUCT_DESCRIPTION", "Units": "UNITS_SOLD", "Price": "TOTAL_DOLLARS"}


def _audit_sides(spark, sf) -> list[DataFrame]:
    return [side(spark, sf).withColumnsRenamed(_AUDIT_NAMES) for side in (sides.bau, sides.test)]


def _presence(spark, sf) -> DataFrame:
    return au.presence_of_rows(*_audit_sides(spark, sf), exact=True)


def _audit_differences(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("UPC_CODE").alias("upc"), F.col("PRODUCT_DESCRIPTION").alias("descr"),
        F.round("Units Difference", 4).alias("units_diff"),
        F.round("Dollar Difference", 4).alias("dollar_diff"),
        F.round("`Unit % Difference`", 6).alias("unit_change"),
        F.round("`Dollar % Difference`", 6).alias("dollar_change"),
    )


@register
def audit_inner_diff(spark, sf):
    return _audit_differences(au.differences_of(_presence(spark, sf)))


@register
def audit_outer_presence(spark, sf):
    return _names(
        _presence(spark, sf),
        upc="UPC_CODE", descr="PRODUCT_DESCRIPTION", bau_units="BAU Units",
        bau_dollars="BAU Dollars", test_units="TEST Units", test_dollars="TEST Dollars",
        present_in="Present In",
    )


@register
def audit_key_counts(spark, sf):
    return au.key_counts(_presence(spark, sf))


def _agreement_view(df: DataFrame) -> DataFrame:
    return _names(
        df, upc="UPC_CODE", bau_descriptions="n_bau", test_descriptions="n_test",
        shared_descriptions="n_shared", mismatched_pairs="mismatched_pairs",
    )


@register
def audit_upc_agreement(spark, sf):
    return _agreement_view(au.common_upcs(au.upc_agreement(_presence(spark, sf))))


@register
def audit_disjoint_desc(spark, sf):
    return _agreement_view(au.disjoint_upcs(au.upc_agreement(_presence(spark, sf))))


@register
def audit_desc_mismatch(spark, sf):
    presence = stored(_presence(spark, sf))
    return _names(
        au.description_mismatch(presence, au.upc_agreement(presence)),
        upc="UPC_CODE", descr="PRODUCT_DESCRIPTION", side="side", units="units",
        dollars="dollars", partners="partners",
    )


@register
def audit_mismatch_report(spark, sf):
    presence = stored(_presence(spark, sf))
    report = au.mismatch_report(presence, au.upc_agreement(presence))
    return report.select(
        F.col("UPC_CODE").alias("upc"), F.col("SIDE").alias("side"),
        F.col("PRODUCT_DESCRIPTION").alias("descr"),
        F.round("BAU_TOTAL_UNITS", 2).alias("bau_units"),
        F.round("TEST_TOTAL_UNITS", 2).alias("test_units"),
        F.round("BAU_TOTAL_DOLLARS", 2).alias("bau_dollars"),
        F.round("TEST_TOTAL_DOLLARS", 2).alias("test_dollars"),
    )


@register
def audit_one_store(spark, sf):
    """Rows of one store with its code read as a number."""
    rows = table(spark, sf, "lineitem").select(
        F.lpad(F.col("l_suppkey").cast("string"), 5, "0").alias("Store"), "l_partkey", "l_quantity"
    )
    return au.store_rows(rows, "00003").groupBy(F.col("Store").alias("store")).agg(
        F.count(F.lit(1)).alias("n"), exact_sum("l_quantity").alias("units")
    )


# --- more readers ----------------------------------------------------------


@register
def read_mixed_headers_store(spark, sf):
    raw = read_delimited(
        spark, raw_files(spark, sf, "bau", "mixed"), ",", encoding="auto", mixed_headers=True
    )
    return _names(_level(raw, "store"), **_STORE)


@register
def read_start_line_store(spark, sf):
    config = TABLE_CONFIG.with_(start_line=len(sides.BANNER))
    raw = read_pos(spark, raw_files(spark, sf, "bau", "banner"), config)
    return _names(_level(raw, "store"), **_STORE)


@register
def line_numbering(spark, sf):
    """Record files alternate H and D lines, so even line numbers are H lines."""
    lines = read_lines(spark, raw_files(spark, sf, "bau", "records"), ordered=True)
    return (
        number_lines(lines)
        .groupBy(
            (F.col(LINE_NO) % 2).cast("long").alias("odd"), F.substring("value", 1, 1).alias("kind")
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


@register
def line_numbers(spark, sf):
    """The number of every line; the files are in the order of their keys."""
    lines = read_lines(spark, raw_files(spark, sf, "bau", "numbered"), ordered=True)
    cells = F.split("value", r"\|")
    return number_lines(lines).select(
        cells[0].cast("long").alias("order_key"), cells[1].cast("long").alias("line_number"), F.col(LINE_NO).alias("line_no")
    )


@register
def read_quoted_item(spark, sf):
    """Descriptions that go on over a line break."""
    config = TABLE_CONFIG.with_(quoted_newlines=True)
    return _names(_level(read_pos(spark, raw_files(spark, sf, "bau", "quoted"), config), "item"), **_ITEM)


def _in_order(spark, sf, kind: str) -> str:
    """Files of one kind, a file per part, in the order of their keys; ``part=0`` is the first one."""
    return raw_files(spark, sf, "bau", f"ordered_{kind}")


@register
def preview_fixed(spark, sf):
    """First 20 records of the first file, as a person sees them."""
    return preview_raw(spark, _in_order(spark, sf, "fixed"), "fixed", layout=sides.FIXED_LAYOUT)


@register
def preview_delimited(spark, sf):
    return preview_raw(spark, _in_order(spark, sf, "delimited"), "delimited")


@register
def preview_record_rows(spark, sf):
    return preview_records(spark, _in_order(spark, sf, "records"), ["H", "D"])


@register
def preview_transaction_rows(spark, sf):
    """Details of the first orders with the totals of their trailers."""
    rows = preview_transactions(
        spark, _in_order(spark, sf, "transactions"), "HDR", sides.HEADER_LAYOUT, sides.DETAIL_LAYOUT,
        trailer_prefix="TRL", trailer_layout=sides.TRAILER_LAYOUT,
    )
    return _names(rows, order_key="Store", upc="UPC", descr="Description", units="Units", price="Price", total_units="TotalUnits", total_price="TotalPrice")


# --- whole runs ------------------------------------------------------------


@register
def two_level_summary(spark, sf):
    """Store and item sums from one scan, as one table."""
    both = sm.two_level_summary(to_sales_rows(sides.bau(spark, sf), TABLE_CONFIG), exact=True)
    is_item = F.col("is_item") == 1
    return both.select(
        F.when(is_item, "item").otherwise("store").alias("level"),
        F.when(is_item, F.col("UPC_CODE")).otherwise(F.col("STORE_NUMBER")).alias("key"),
        F.when(is_item, F.col("PRODUCT_DESCRIPTION")).otherwise("").alias("descr"),
        F.col("Units").alias("units"),
        F.when(is_item, F.col("TOTAL_DOLLARS")).otherwise(F.col("Totalprice")).alias("dollars"),
    )


def _two_formats(spark, sf):
    """BAU from delimited files against TEST from fixed-width files."""
    configs = CONFIGS["delimited"], CONFIGS["fixed"]
    raw = [
        read_pos(spark, raw_files(spark, sf, side, kind), config)
        for side, kind, config in zip(("bau", "test"), ("delimited", "fixed"), configs)
    ]
    return reconcile(*raw, *configs, exact=True)


def _kept(run: RunResult, frame: DataFrame) -> DataFrame:
    """A frame of a run, stored so that the run's caches can go."""
    out = stored(frame)
    run.release()
    return out


@register
def reconcile_two_formats(spark, sf):
    run = _two_formats(spark, sf)
    return _kept(run, _store_view(run["store_validation"]))


@register
def reconcile_item_comparison(spark, sf):
    run = _two_formats(spark, sf)
    return _kept(run, _item_view(run["item_comparison"]))


@register
def reconcile_item_summary(spark, sf):
    run = _two_formats(spark, sf)
    return _kept(run, _presence_view(run["item_summary"]))


@register
def reconcile_store_list(spark, sf):
    run = _two_formats(spark, sf)
    return _kept(run, run["store_list"])


@register
def reconcile_reviews(spark, sf):
    """The consolidated reviews of both sides."""
    run = _two_formats(spark, sf)
    both = run["bau_review"].unionByName(run["test_review"])
    return _kept(run, both.withColumn("total_units", F.round("total_units", 2)))


@register
def reconcile_metrics(spark, sf):
    """Counts seen on the same pass as the reports, one row per side."""
    run = _two_formats(spark, sf)
    _kept(run, run["item_summary"])
    seen = [(name, *(m[k] for k in ("rows", "bad_measures", "no_store"))) for name, m in run.metrics().items()]
    return spark.createDataFrame(seen, "side string, n_rows long, bad_measures long, no_store long")


@register
def reconcile_counts(spark, sf):
    """All counts of a run: BAU files with orphaned details against TEST rows with bad measures and no store.

    BAU has a delivery folder per part of its stores, TEST one per month.
    """
    seen = Observation("reader")
    config = CONFIGS["transactions"]
    bau = read_pos(spark, raw_files(spark, sf, "bau", "orphans"), config, with_file=True, seen=seen)
    bau = bau.withColumn(FILE, F.regexp_extract(FILE, "part=([^/]+)", 1))
    line = F.col("LineNumber")
    test = sides.test(spark, sf).withColumns({
        "Store": F.when(line != 6, F.col("Store")),
        "Price": F.when(line == 5, "N/A").otherwise(F.col("Price").cast("string")),
        FILE: F.col("Month"),
    })
    run = reconcile(bau, test, config, TABLE_CONFIG, exact=True, seen={"bau": seen})
    counts = _kept(run, run.counts)
    rows = [(name, *(m.get(k) for k in ("rows", "bad_measures", "no_store", "details", "orphan_details"))) for name, m in run.metrics().items()]
    told = spark.createDataFrame(rows, "side string, n_rows long, bad_measures long, no_store long, details long, orphan_details long")
    return told.join(counts, "side")


@register
def reconcile_file_reviews(spark, sf):
    """Reviews per file inside a run: BAU rows by month, TEST rows by line state."""
    bau = sides.bau(spark, sf).withColumn(FILE, F.col("Month"))
    test = sides.test(spark, sf).withColumn(FILE, F.concat(F.lit("state-"), "Status"))
    run = reconcile(bau, test, TABLE_CONFIG, TABLE_CONFIG, exact=True)
    both = run["bau_review"].withColumn("side", F.lit("bau")).unionByName(run["test_review"].withColumn("side", F.lit("test")))
    return _kept(run, both.withColumn("total_units", F.round("total_units", 2)))


def _onboarding(spark, sf) -> RunResult:
    """The TEST rows with a store list file made from ``supplier``."""
    path = f"{scratch_dir(spark)}/stores"
    write_report(
        table(spark, sf, "supplier").select(
            F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 10, "0"), F.lit(" ")).alias("Store")
        ),
        path,
    )
    stores = read_store_list(spark, path)
    return onboard(sides.test(spark, sf), TABLE_CONFIG, stores, "Store", exact=True)


@register
def onboard_store_list(spark, sf):
    run = _onboarding(spark, sf)
    return _kept(run, run["store_list"])


@register
def onboard_upc_summary(spark, sf):
    run = _onboarding(spark, sf)
    return _kept(run, _names(run["upc_summary"], **_ITEM))


@register
def onboard_file_review(spark, sf):
    run = _onboarding(spark, sf)
    return _kept(run, run["file_review"].withColumn("total_units", F.round("total_units", 2)))


@register
def item_audit_comparison(spark, sf):
    """The comparison of a whole item audit, from its one table of joined keys."""
    run = _item_audit(spark, sf)
    out = stored(_audit_differences(run["comparison"]))
    run["presence"].unpersist()
    return out


@register
def item_audit_counts(spark, sf):
    """Key, UPC and mismatch counts of a whole item audit."""
    run = _item_audit(spark, sf)
    counts = run["key_counts"].join(run["mismatch_count"]).join(
        run["common_upcs"].agg(F.count(F.lit(1)).alias("common_upcs"))
    ).join(run["disjoint_upcs"].agg(F.count(F.lit(1)).alias("disjoint_upcs")))
    out = stored(counts)
    run["presence"].unpersist()
    return out


def _item_audit(spark, sf) -> dict[str, DataFrame]:
    return item_audit(*_audit_sides(spark, sf), exact=True)


@register
def report_round_trip(spark, sf):
    """The store comparison written as a CSV report and read back."""
    path = f"{scratch_dir(spark)}/report"
    write_report(_store_diffs(spark, sf), path)
    back = read_delimited(spark, path, ",")
    numbers = [F.col(f"`{c}`").cast("double").alias(c) for c in back.columns[1:]]
    return _store_view(back.select("STORE_NUMBER", *numbers))


@register
def audit_from_parquet(spark, sf):
    """Key counts from both sides' row-level Parquet output."""
    sums = []
    for side in (sides.bau, sides.test):
        path = f"{scratch_dir(spark)}/rows"
        write_report(
            side(spark, sf).select(
                F.col("Store"), F.col("UPC").alias("UPC_CODE"),
                F.col("Description").alias("PRODUCT_DESCRIPTION"),
                F.col("Units").alias("UNITS_SOLD"), F.col("Price").alias("TOTAL_DOLLARS"),
            ),
            path, "parquet",
        )
        sums.append(au.audit_summary(read_side_parquet(spark, path), exact=True))
    return au.key_counts(au.outer_presence(*sums))


@register
def landing_stream_store(spark, sf):
    """The store summary computed as files land; every trigger rewrites the table."""
    out = scratch_dir(spark)
    stream = stream_summary(
        spark, raw_files(spark, sf, "bau", "delimited"), CONFIGS["delimited"], "store", exact=True
    )
    query = (
        stream.writeStream.outputMode("complete")
        .option("checkpointLocation", f"{out}/progress")
        .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/summary"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return _names(spark.read.parquet(f"{out}/summary"), **_STORE)


@register
def landing_table_store(spark, sf):
    """The same into a growing table, three files at a time; the folder is then replayed, which changes nothing."""
    out = scratch_dir(spark)
    table = SummaryTable(spark, f"{out}/table", "store", buckets=16)
    for replay in range(2):
        writer = stream_into(spark, raw_files(spark, sf, "bau", "delimited"), CONFIGS["delimited"], table, max_files=3)
        writer.option("checkpointLocation", f"{out}/progress-{replay}").trigger(availableNow=True).start().awaitTermination()
    return _names(table.read(), **_STORE)


# --- profiles and configurations -------------------------------------------


@register
def profile_formats(spark, sf):
    """What profiling finds in the raw files of each format."""
    kinds = ("delimited", "fixed", "records", "transactions")
    paths = [raw_files(spark, sf, "bau", kind) for kind in kinds]
    return (
        profile_files(spark, paths)
        .select(
            F.regexp_extract(FILE, "/bau-([a-z]+)/", 1).alias("kind"),
            "file_type", "delimiter", "has_header", "encoding",
            "header_prefix", F.array_join("record_types", ",").alias("record_types"),
            F.array_join("columns", ",").alias("columns"), "store_col", "price_col",
        )
        .distinct()
    )


@register
def profile_roles(spark, sf):
    """Types of all values and the five suggested roles, per file."""
    found = profile_files(spark, _in_order(spark, sf, "delimited"))
    return found.select(
        F.regexp_extract(FILE, r"part=(\d+)", 1).cast("long").alias("part"), "file_type", "delimiter", "has_header",
        F.array_join("columns", ",").alias("columns"), F.array_join("data_types", ",").alias("data_types"),
        "store_col", "upc_col", "desc_col", "units_col", "price_col",
    )


@register
def profile_transactions(spark, sf):
    """Header / detail / trailer files whose headers go on with a number: the prefix is that of the header alone."""
    found = profile_files(spark, _in_order(spark, sf, "transactions"))
    return found.groupBy("file_type", "header_prefix", "has_header").agg(F.count(F.lit(1)).alias("files"))


@register
def config_check(spark, sf):
    """One configuration per supplier, with different parts left out."""
    s = table(spark, sf, "supplier")
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    known = F.array(F.lit("Store"), F.lit("UPC"), F.lit("Units"), F.lit("Price"))
    configs = s.select(
        "s_suppkey",
        F.when(key % 4 == 0, "delimited").when(key % 4 == 1, "fixed").when(key % 4 == 2, "multiline")
        .alias("file_type"),
        F.when(nation % 2 == 0, "layout.csv").alias("layout_file"),
        F.when(nation % 3 == 0, "HDR").alias("header_prefix"),
        F.when(nation % 5 == 0, "h.csv").alias("header_layout_file"),
        F.when(nation % 5 != 0, "d.csv").alias("detail_layout_file"),
        F.when(key % 3 == 0, F.array(F.lit("H"), F.lit("D"))).alias("ml_record_types"),
        F.when(key % 7 != 0, known).alias("schema"),
        F.lit(None).cast("array<string>").alias("detected_columns"),
        F.when(key % 5 != 0, "Store").alias("store_col"),
        F.lit("UPC").alias("upc_col"),
        F.when(key % 6 == 0, "Text").alias("desc_col"),
        F.when(nation % 4 != 0, "Units").alias("units_col"),
        F.when(nation % 4 != 1, "Price").alias("price_col"),
    )
    return configs.select("s_suppkey", F.array_join(config_errors(), "; ").alias("errors"))


@register
def mapping_check(spark, sf):
    """One column mapping per supplier, with unset and repeated columns."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    mapped = table(spark, sf, "supplier").select(
        "s_suppkey",
        F.concat(F.lit("c"), (nation % 3).cast("string")).alias("store_col"),
        F.concat(F.lit("c"), (key % 3).cast("string")).alias("upc_col"),
        F.when(key % 2 == 0, "c9").alias("desc_col"),
        F.when(nation % 2 == 0, "c9").otherwise("").alias("units_col"),
        F.lit("c1").alias("price_col"),
    )
    return check_mapping(mapped).select(
        "s_suppkey", F.size("errors").alias("n_errors"), F.array_join("errors", "; ").alias("errors")
    )
