"""Layouts as data, and many rules in one pass."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from posrecon.config import FormatConfig, ValidationRule, load_format_config, save_format_config
from posrecon.operators.summarize import aggregate_by_rule, aggregate_by_rules, rule_part
from posrecon.sources.by_layout import load_configs, load_layouts, read_by_layout, sales_rows_by_layout
from posrecon.sources.lines import FILE
from tests.test_records_in_splits import path_up

ROLES = dict(store_col="s", upc_col="u", desc_col="d", units_col="n", price_col="p")
name_of = lambda: F.element_at(F.split(FILE, "/"), -2)


def write(spark, root, name, layout, lines, **options):
    (root / "data" / name).mkdir(parents=True)
    (root / "conf" / "layouts").mkdir(parents=True, exist_ok=True)
    (root / "conf" / "layouts" / f"{name}.csv").write_text(layout)
    (root / "data" / name / "f.txt").write_bytes("".join(x + "\n" for x in lines).encode(options.get("encoding", "cp1252")))
    config = FormatConfig(name=name, file_type="fixed", layout_file=f"layouts/{name}.csv", **{**ROLES, **options})
    save_format_config(config, f"file://{root}/conf/{name}.json", spark)
    assert load_format_config(f"{root}/conf/{name}.json") == config


@pytest.fixture
def three(spark, tmp_path):
    write(spark, tmp_path, "a", "From,Length,Field,Type\n1,3,s,text\n4,2,u,numeric\n6,4,d,text\n10,2,n,numeric\n12,5,p,numeric\n",
          ["S0107Wídg0300250", "", "S0208"], encoding="utf-8")
    write(spark, tmp_path, "b", "FIELD,FROM,LENGTH\np,1,4\nn,5,4\nd,9,5\nu,14,2\ns,16,2\n",
          ["banner", "", "12500200caf\xe9 77S1", "00100100teas 78S2"], start_line=2, implied_units=True, implied_dollars=True, price_type="Unit Price")
    write(spark, tmp_path, "c", "from,length,field,type\n1,1,k,text\n2,1,s,text\n3,6,u,date\n9,1,d,text\n10,1,n,text\n11,3,p,text\n",
          ["Rx240115yZ1.5", "Hx240115yZ9.9", "R"], record_type="R")
    return tmp_path


def rows_of(spark, root):
    configs = load_configs(spark, f"{root}/conf/*.json", load_layouts(spark, f"{root}/conf/layouts"))
    return read_by_layout(spark, f"{root}/data/*", configs, name_of())


def test_each_file_is_cut_by_its_own_layout(spark, three):
    raw = rows_of(spark, three)
    assert Counter(tuple(r)[:6] for r in raw.collect()) == Counter([
        ("S01", "7", "Wídg", "3", "250", "a"), ("", "0", "", "0", "0", "a"), ("S02", "8", "", "0", "0", "a"),
        ("S1", "77", "café", "0200", "1250", "b"), ("S2", "78", "teas", "0100", "0010", "b"),
        ("x", "2024-01-15", "y", "Z", "1.5", "c"), ("", "", "", "", "", "c"),
    ])
    got = {(r.name, r.STORE_NUMBER): (r.Units, r.Totalprice, r.TOTAL_DOLLARS) for r in sales_rows_by_layout(raw).collect()}
    assert got["b", "S1"] == (2.0, 25.0, 12.5) and got["a", "S01"] == (3.0, 250.0, 250.0) and got["c", "x"] == (0.0, 1.5, 1.5)
    (up,) = path_up(raw.select("*"), "FileScan text")
    assert not any(op.startswith("Exchange") for op in up)


def test_missing_parts_are_errors(spark, three):
    (three / "data" / "z").mkdir()
    (three / "data" / "z" / "f.txt").write_text("x\n")
    with pytest.raises(Exception, match="no configuration for"):
        rows_of(spark, three).collect()
    save_format_config(FormatConfig(name="z", file_type="fixed", layout_file="layouts/none.csv", **ROLES), f"{three}/conf/z.json")
    with pytest.raises(Exception, match="no layout for configuration z"):
        rows_of(spark, three).collect()
    save_format_config(FormatConfig(name="z", file_type="fixed", layout_file="layouts/a.csv", **{**ROLES, "upc_col": "?"}), f"{three}/conf/z.json")
    with pytest.raises(Exception, match="upc column is not in the layout of z"):
        rows_of(spark, three).collect()
    save_format_config(FormatConfig(name="a", file_type="fixed", layout_file="layouts/a.csv", **ROLES), f"{three}/conf/z.json")
    with pytest.raises(Exception, match="two configurations are named a"):
        rows_of(spark, three).collect()


def test_many_rules_equal_each_rule(spark):
    df = spark.range(400).select(
        (F.col("id") % 7).cast("string").alias("STORE_NUMBER"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).cast("string").alias("UPC_CODE"),
        F.lit("d").alias("PRODUCT_DESCRIPTION"), (F.col("id") * 0.5).alias("UNITS_SOLD"), (F.col("id") * 1.25).alias("TOTAL_DOLLARS"),
    )
    rules = {
        "default": ValidationRule(), "again": ValidationRule(group_by_columns=["PRODUCT_DESCRIPTION", "UPC_CODE"], aggregation_columns=["UNITS_SOLD"]),
        "store": ValidationRule(group_by_columns=["STORE_NUMBER"], aggregation_columns=["TOTAL_DOLLARS"]),
        "all": ValidationRule(group_by_columns=["STORE_NUMBER", "UPC_CODE"]),
    }
    table = aggregate_by_rules(df, rules, "item", exact=True)
    for name, rule in rules.items():
        got, want = rule_part(table, name, rule, "item"), aggregate_by_rule(df, rule, "item", exact=True)
        assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert len(path_up(table.select("*"), "Range (")) == 1
    with pytest.raises(ValueError, match="columns not found: x"):
        aggregate_by_rules(df, {"r": ValidationRule(required_columns=["x"])}, "item")
    with pytest.raises(ValueError, match="grouped and summed"):
        aggregate_by_rules(df, {"r": ValidationRule(group_by_columns=["UNITS_SOLD"])}, "item")
