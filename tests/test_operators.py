"""Measures, comparisons, ranks, lists, reviews and audits on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from posrecon.config import UNIT_PRICE, FormatConfig, ValidationRule
from posrecon.functions import measures as m
from posrecon.functions import text as tx
from posrecon.operators import audit as au
from posrecon.operators import compare as cmp
from posrecon.operators.canonical import to_item_rows, to_store_rows
from posrecon.operators.review import file_review, review_from_summaries, review_rows
from posrecon.operators.skew import lookup_by_key
from posrecon.operators.stores import store_list_diff, store_list_text
from posrecon.operators.summarize import (
    aggregate,
    aggregate_by_rule,
    item_part,
    merge_summaries,
    store_part,
    two_level_summary,
)
from posrecon.plans.item_audit import item_audit
from posrecon.sources.delimited import list_files, read_delimited
from posrecon.sources.dispatch import read_pos
from tests.fixtures import FORMATS, NAMES, ROLES, ROWS, TEST_ROWS, rounded

CONFIG = FormatConfig(file_type="delimited", delimiter=",", **ROLES)
STORE = "STORE_NUMBER string, Units double, Totalprice double"
ITEM = "UPC_CODE string, PRODUCT_DESCRIPTION string, UNITS_SOLD double, TOTAL_DOLLARS double"


def values(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_safe_numeric(spark):
    cases = {
        "1,234.50": 1234.5, "$5": 5.0, "(5.00)": 5.0, "12 EA": 0.0, "N/A": 0.0, "1e3": 1000.0,
        "-7": -7.0, " 8 ": 8.0, "": 0.0, None: 0.0, "NaN": 0.0, "Infinity": 0.0, "0x1p3": 13.0,
        "1d": 1.0, "5-": 0.0, "1.5.2": 0.0,
    }
    got = values(spark, "s string", [(k,) for k in cases], "s", m.safe_numeric("s"))
    assert dict(got) == cases
    bad = values(spark, "s string", [("N/A",), ("5",), ("",), (None,)], m.is_bad_measure("s"))
    assert bad == [(True,), (False,), (False,), (False,)]


@pytest.mark.parametrize(
    "units,price,options,expected",
    [
        ("1000", "5000", dict(implied_units=True, implied_dollars=True), (10.0, 50.0)),
        ("10", "5", dict(price_type=UNIT_PRICE), (10.0, 50.0)),
        ("1000", "500", dict(implied_units=True, implied_dollars=True, price_type=UNIT_PRICE), (10.0, 50.0)),
        ("1000", "9999", dict(implied_units=True, implied_dollars=True), (10.0, 99.99)),
        ("10", "9.99", dict(price_type=UNIT_PRICE), (10.0, 99.9)),
    ],
)
def test_store_measures(spark, units, price, options, expected):
    df = spark.createDataFrame([("S1", units, price)], "s string, u string, p string")
    row = to_store_rows(df, "s", "u", "p", **options).first()
    assert (row["Units"], round(row["Totalprice"], 6)) == expected


def test_item_rows_trim_and_fill(spark):
    df = spark.createDataFrame([(" 1 ", None, "1", "2")], "u string, d string, q string, p string")
    assert tuple(to_item_rows(df, "u", "d", "q", "p").first()) == ("1", "", 1.0, 2.0)
    with pytest.raises(ValueError, match="columns not found"):
        to_item_rows(df, "u", "nope", "q", "p")


def test_pct_and_tolerance_and_presence(spark):
    rows = [(0.0, 0.0), (0.0, 5.0), (5.0, 0.0), (10.0, 15.0)]
    assert values(spark, "a double, b double", rows, m.pct_diff("a", "b")) == [
        (0.0,), (-100.0,), (100.0,), (-50.0,),
    ]
    assert values(
        spark, "a double", [(5.0,), (-5.0,), (5.1,), (None,)], m.within_tolerance("a", 5.0)
    ) == [("Pass",), ("Pass",), ("Fail",), ("Fail",)]
    rows = [(1.0, None), (None, 1.0), (1.0, 1.0), (None, None)]
    assert values(spark, "a double, b double", rows, m.classify_presence("a", "b")) == [
        ("Present only in BAU",), ("Present only in TEST",), ("Present in Both",), ("Present in Both",),
    ]
    rows = [(10.0, 15.0), (0.0, 5.0), (0.0, 0.0)]
    assert values(spark, "a double, b double", rows, m.fraction_change("a", "b")) == [
        (0.5,), (0.0,), (0.0,),
    ]


def test_text_functions(spark):
    rows = [("\t  x 　\n",), ('a,"b,c",d,"e,',), ("00120",), ("000",)]
    got = values(
        spark, "s string", rows, tx.strip(F.col("s")), tx.delimiter_count(F.col("s"), ","),
        tx.typed(F.col("s"), "numeric"),
    )
    assert got[0][0] == "x" and got[1][1] == 3
    assert got[2][2] == "120" and got[3][2] == "0"


def _store(spark, rows):
    return spark.createDataFrame(rows, STORE)


def test_store_diffs_hand_computed(spark):
    def rows(data):
        return to_store_rows(spark.createDataFrame(data, NAMES), "Store", "Units", "Price")

    got = cmp.store_validation(rows(ROWS), rows(TEST_ROWS))
    assert got.columns == [
        "STORE_NUMBER", "Units_Prod", "Totalprice_Prod", "Units_Test", "Totalprice_Test",
        "Units_Diff", "Sales_Diff", "Units_Diff_%", "Sales_Diff_%",
    ]
    assert [(r[0], r[1], r[3], r[5], round(r[7], 6)) for r in got.collect()] == [
        ("S001", 15.0, 17.0, -2.0, -13.333333), ("S002", 8.0, 8.0, 0.0, 0.0),
        ("S003", 20.0, 20.0, 0.0, 0.0), ("S004", 0.0, 7.0, -7.0, -100.0),
    ]


def test_store_diffs_empty_disjoint_and_missing_measure(spark):
    assert cmp.store_diffs(_store(spark, []), _store(spark, [])).count() == 0
    got = cmp.store_diffs(_store(spark, [("A", 10.0, 100.0)]), _store(spark, [("B", 5.0, 50.0)]))
    assert [(r[0], r["Units_Diff_%"]) for r in got.collect()] == [("A", 100.0), ("B", -100.0)]
    units = _store(spark, [("A", 10.0, 1.0)]).drop("Totalprice")
    assert cmp.store_diffs(units, units).first()["Totalprice_Prod"] == 0.0


def test_full_join(spark):
    left = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    right = spark.createDataFrame([("b", 3.0), ("c", 4.0)], "k string, v double")
    got = cmp.full_join_with_coalesce(left, right, ["k"])
    assert got.columns == ["k", "v", "v_Test"]
    assert sorted(map(tuple, got.collect())) == [("a", 1.0, 0.0), ("b", 2.0, 3.0), ("c", 0.0, 4.0)]


def test_item_comparison(spark):
    bau = spark.createDataFrame([("1", "A", 10.0, 100.0), ("2", "B", 5.0, 50.0)], ITEM)
    test = spark.createDataFrame([("1", "A", 12.0, 90.0), ("3", "C", 1.0, 2.0)], ITEM)
    comparison = cmp.item_comparison(bau, test)
    assert comparison.columns == [
        "UPC_CODE", "PRODUCT_DESCRIPTION", "BAU Units", "BAU Dollars", "TEST Units",
        "TEST Dollars", "Present In", "Units Difference", "Dollar Difference",
        "Unit % Difference", "Dollar % Difference",
    ]
    got = {r[0]: tuple(r)[6:] for r in comparison.collect()}
    assert got["1"] == ("Present in Both", -2.0, 10.0, -20.0, 10.0)
    assert got["2"] == ("Present only in BAU", 5.0, 50.0, 100.0, 100.0)
    assert got["3"] == ("Present only in TEST", -1.0, -2.0, -100.0, -100.0)
    assert [tuple(r) for r in cmp.item_summary(comparison).collect()] == [
        ("Present in Both", -2.0, 10.0), ("Present only in BAU", 5.0, 50.0),
        ("Present only in TEST", -1.0, -2.0),
    ]


def test_sort_and_top(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0)], "k string, `d_%` double")
    assert [r[0] for r in cmp.sort_by_diff(df, "d_%").collect()] == ["b", "c", "a"]
    assert [r[0] for r in cmp.sort_by_diff(df, "d_%", ascending=True).collect()] == ["b", "a", "c"]
    tied = df.union(df)
    assert cmp.sort_by_diff(tied, "d_%", tiebreak=tied.columns[:1]).count() == 6
    assert [r[0] for r in cmp.top_by_diff(df, 2, "d_%").collect()] == ["b", "c"]


def _average_ranks(values, ascending):
    known = [v for v in values if v is not None]
    out = []
    for v in values:
        if v is None:
            out.append(None)
            continue
        before = sum(1 for x in known if (x < v if ascending else x > v))
        ties = known.count(v)
        out.append(int(before + (ties + 1) / 2))
    return out


@pytest.mark.parametrize("few", [0, 200_000])
@pytest.mark.parametrize("ascending", [True, False])
def test_rank(spark, monkeypatch, ascending, few):
    monkeypatch.setattr(cmp, "FEW_VALUES", few)
    rng = random.Random(3)
    data = [None if i % 17 == 0 else (0.0 if i % 3 == 0 else round(rng.uniform(-9, 9), 1)) for i in range(600)]
    df = spark.createDataFrame(list(enumerate(data)), "id int, `Units_Diff_%` double")
    got = cmp.rank_by_diff(df, ascending=ascending).orderBy("id").collect()
    assert [r["Rank"] for r in got] == _average_ranks(data, ascending)
    assert df.columns + ["Rank"] == got[0].__fields__


def test_lookup_with_hot_and_cold_keys(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k"),
        "id",
    )
    table = rows.groupBy("k").count().where("k is not null").select("k", "count", (F.col("k") * 2).alias("v"))
    got = lookup_by_key(rows, table, "k", "v", "count", hot_keys=3).collect()
    assert len(got) == 5000
    assert all(r["v"] == (None if r["k"] is None else r["k"] * 2) for r in got)


def test_store_lists(spark):
    def frame(*names):
        return spark.createDataFrame([(n,) for n in names], "store string")

    both = store_list_diff(frame(" Store1 ", "B", "a, z", None), frame("store1", "c", "C "), "store", "store")
    assert sorted(map(tuple, store_list_text(both).collect())) == [
        ("missing_in_prod", "c", 1), ("missing_in_test", "a, z", 2), ("missing_in_test", "b", 2),
    ]
    assert store_list_diff(frame("A"), frame("a"), "store", "store").count() == 0
    assert store_list_diff(frame("x"), frame(), "store", "store").count() == 1
    many = store_list_text(store_list_diff(frame(*(f"s{i}" for i in range(1500))), frame("s7"), "store", "store"))
    assert many.count() == 1499 and many.select("n_stores").distinct().collect() == [(1499,)]


def test_exact_sums_join_as_longs_or_decimals_alike(spark):
    """the two ways meet where a sum no longer fits a long."""
    edge = float((1 << 62) // 10**4)
    values = [0.0, -0.1, 12.3456, 99.99995, -1e9 - 0.25, edge - 1024, edge, edge + 4096, -edge, -edge - 4096, 1e16]
    rows = spark.createDataFrame(list(enumerate(values)), "k int, v double").repartition(3)
    pairs = rows.union(rows.select("k", F.lit(0.5))).groupBy("k").agg(m.exact_sum("v").alias("s"))
    exact = lambda v: float((round(v * 1e4) + 5000)) / 1e4
    assert {r.k: r.s for r in pairs.collect()} == {k: exact(v) for k, v in enumerate(values)}


def test_exact_sums_go_beyond_long(spark):
    sums = spark.range(1000).select(
        m.exact_sum(F.lit(1e13)).alias("a"), m.exact_sum(F.lit(-0.1)).alias("b"),
        m.exact_sum(F.when(F.col("id") % 2 == 0, 1e16).otherwise(-1e16) + F.lit(0.0)).alias("c"),
        m.exact_sum(F.lit(None).cast("double")).alias("d"), m.exact_sum(F.col("id") * 1e14).alias("e"),
    ).first()
    assert tuple(sums) == (1e16, -100.0, 0.0, None, 4.995e19)


def test_merge_rule_and_two_levels(spark):
    df = spark.createDataFrame(ROWS, NAMES)
    whole = aggregate(df, "store", CONFIG)
    first = aggregate(df.where("Store = 'S001'"), "store", CONFIG)
    rest = aggregate(df.where("Store <> 'S001'"), "store", CONFIG)
    assert sorted(rounded(merge_summaries([first, rest]))) == sorted(rounded(whole))
    rule = ValidationRule(group_by_columns=["Description"], aggregation_columns=["n"])
    rows = df.select("Description", F.col("Units").cast("double").alias("n"))
    assert sorted(map(tuple, aggregate_by_rule(rows, rule, "item").collect())) == [
        ("Doohickey", 20.0), ("Gadget B", 5.0), ("Widget A", 18.0),
    ]
    from posrecon.operators.canonical import to_sales_rows

    both = two_level_summary(to_sales_rows(df, CONFIG))
    assert sorted(rounded(store_part(both))) == sorted(rounded(whole))
    assert sorted(rounded(item_part(both))) == sorted(rounded(aggregate(df, "item", CONFIG)))


def test_file_review(spark, tmp_path):
    head = "Store,UPC,Description,Units,Price\n"
    (tmp_path / "a.csv").write_text(head + "S1,1001,Widget,10,50\nS2,1002,Gadget,5,25\n")
    (tmp_path / "b c+é.csv").write_text(head + "S2,1002,Gadget,5,25.004\nS2,1002,Gadget,5,1.5\n")
    (tmp_path / "empty.csv").write_text(head)
    raw = read_pos(spark, str(tmp_path), CONFIG, with_file=True)
    got = file_review(review_rows(raw, CONFIG), list_files(spark, str(tmp_path)))
    assert got.columns == ["filename", "store_count", "upc_count", "total_units", "total_dollars"]
    rows = sorted(map(tuple, got.collect()))
    assert rows[0] == ("a.csv", 2, 2, 15.0, 75.0)
    assert rows[1] == ("b c+é.csv", 1, 1, 10.0, 26.5)
    assert rows[2] == ("empty.csv", 0, 0, 0.0, 0.0)


def test_review_from_summaries(spark):
    stores = _store(spark, [("S1", 10.0, 50.0), ("S2", 5.0, 25.0)])
    items = spark.createDataFrame([("1", "W", 10.0, 50.0), ("2", "G", 5.0, 25.0)], ITEM)
    assert tuple(review_from_summaries(stores, items, ["x/a.csv", "b.csv"]).first()) == (
        "2 files (aggregated)", 2, 2, 15.0, 75.0,
    )
    assert review_from_summaries(stores, items, ["x/a.csv"]).first()[0] == "a.csv"


def test_item_audit(spark):
    bau = [("1", "A", "2", "20"), ("1", "B", "1", "x"), ("2", "C", "5", "50"), ("3", "D", "1", "1"),
           (None, "E", "1", "1"), ("5", "P", "1", "1"), ("5", "Q", "1", "1")]
    test = [("1", "A", "3", "30"), ("2", "C2", "5", "50"), ("2", "C1", "1", "10"), ("4", "F", "1", "1"),
            ("5", "R", "1", "1")]
    schema = "UPC_CODE string, PRODUCT_DESCRIPTION string, UNITS_SOLD string, TOTAL_DOLLARS string"
    out = item_audit(spark.createDataFrame(bau, schema), spark.createDataFrame(test, schema))
    row = out["comparison"].first()
    assert (row["Units Difference"], row["Unit % Difference"]) == (1.0, 0.5)
    assert tuple(out["key_counts"].first()) == (5, 4, 1)
    assert sorted(r[0] for r in out["common_upcs"].collect()) == ["1", "2", "5"]
    # pairs: UPC 1 (B,A); UPC 2 (C,C2),(C,C1); UPC 5 (P,R),(Q,R)
    assert out["mismatch_count"].first()[0] == 5
    partners = sorted(
        (r["UPC_CODE"], r["side"], r["PRODUCT_DESCRIPTION"], r["partners"])
        for r in out["description_mismatch"].collect()
    )
    assert partners == [
        ("1", "BAU", "B", 1), ("1", "TEST", "A", 1), ("2", "BAU", "C", 2), ("2", "TEST", "C1", 1),
        ("2", "TEST", "C2", 1), ("5", "BAU", "P", 1), ("5", "BAU", "Q", 1), ("5", "TEST", "R", 2),
    ]
    assert sorted(r[0] for r in out["disjoint_upcs"].collect()) == ["2", "5"]
    two, five = (5.0, 6.0, 50.0, 60.0), (2.0, 1.0, 2.0, 1.0)
    assert sorted(map(tuple, out["mismatch_report"].collect())) == [
        ("2", "BAU", "C", *two), ("2", "TEST", "C1", *two), ("2", "TEST", "C2", *two),
        ("5", "BAU", "P", *five), ("5", "BAU", "Q", *five), ("5", "TEST", "R", *five),
    ]
    out["presence"].unpersist()


def test_mismatch_report_of_a_large_upc(spark):
    bau = spark.createDataFrame([("1", f"d{i}", 1.0, 1.0) for i in range(1300)], ITEM)
    test = spark.createDataFrame([("1", "other", 1.0, 1.0)], ITEM)
    presence = au.outer_presence(au.audit_summary(bau), au.audit_summary(test))
    report = au.mismatch_report(presence, au.upc_agreement(presence)).collect()
    assert sorted(r["PRODUCT_DESCRIPTION"] for r in report if r["SIDE"] == "BAU") == sorted(f"d{i}" for i in range(1300))
    assert len(report) == 1301 and {r["BAU_TOTAL_UNITS"] for r in report} == {1300.0}


def test_store_rows_as_number(spark):
    df = spark.createDataFrame([("00238", 1), ("00239", 2)], "Store string, n int")
    assert [tuple(r) for r in au.store_rows(df, "00238").collect()] == [(238.0, 1)]


def test_duplicate_stores_are_summed(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Store,Units,Price\nS1,5,25\nS1,10,50\nS2,3,15\n")
    df = read_delimited(spark, str(tmp_path))
    assert sorted(rounded(aggregate(df, "store", CONFIG))) == [("S1", 15.0, 75.0), ("S2", 3.0, 15.0)]


def test_unit_price_applies_to_stores_only(spark):
    df = spark.createDataFrame([("S1", "1", "W", "10", "5")], NAMES)
    config = CONFIG.with_(price_type=UNIT_PRICE)
    assert aggregate(df, "store", config).first()["Totalprice"] == 50.0
    assert aggregate(df, "item", config).first()["TOTAL_DOLLARS"] == 5.0
    assert aggregate(df, "upc", config).first()["TOTAL_DOLLARS"] == 5.0


def test_formats_fixture_covers_all_readers():
    assert set(FORMATS) == {"delimited", "fixed", "multiline", "hdr_fixed"}
