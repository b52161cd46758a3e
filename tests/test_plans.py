"""Whole runs, profiling, mapping, configuration checks, history, landing stream."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from posrecon.config import (
    RULE_NAMES,
    FormatConfig,
    OutputConfig,
    ValidationConfig,
    config_from_dict,
    load_format_config,
    save_format_config,
)
from posrecon.operators.summarize import aggregate
from posrecon.plans.config_audit import (
    assert_config_valid,
    audit_configs,
    validate_config,
)
from posrecon.plans.history import last_runs, record_run
from posrecon.plans.mapping import check_mapping, suggest_mapping
from posrecon.plans.profile import config_from_profile, profile_files
from posrecon.plans.reconcile import onboard, reconcile
from posrecon.sources.dispatch import read_pos
from posrecon.sources.layout import resolve_layouts
from posrecon.sources.sinks import write_report, write_reports
from posrecon.sources.tables import read_store_list
from posrecon.streaming.landing import stream_summary
from tests.fixtures import FORMATS, GOLDEN, NAMES, ROLES, ROWS, TEST_ROWS, rounded

CONFIG = FORMATS["delimited"][1]


@pytest.mark.parametrize("fmt", FORMATS)
def test_reconcile(spark, tmp_path, fmt):
    writer, config = FORMATS[fmt]
    for name, rows in (("bau", ROWS), ("test", TEST_ROWS)):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.txt").write_text(writer(rows))
    bau = read_pos(spark, str(tmp_path / "bau"), config, with_file=True)
    test = read_pos(spark, str(tmp_path / "test"), config, with_file=True)
    run = reconcile(bau, test, config, config)
    stores = {r[0]: round(r["Units_Diff_%"], 6) for r in run["store_validation"].collect()}
    assert stores == {"S001": -13.333333, "S002": 0.0, "S003": 0.0, "S004": -100.0}
    assert {tuple(r)[:2] for r in run["item_summary"].collect()} == {
        ("Present in Both", -2.0), ("Present only in TEST", -7.0),
    }
    assert run["item_comparison"].count() == 4
    assert [tuple(r) for r in run["store_list"].collect()] == [("missing_in_prod", "s004")]
    assert tuple(run["bau_review"].first()) == ("bau.txt", 3, 3, 43.0, 429.57)
    assert tuple(run["test_review"].first()) == ("test.txt", 4, 4, 52.0, 519.48)
    metrics = run.metrics()
    assert metrics["bau"]["rows"] == 4 and metrics["bau"]["bad_measures"] == 0
    written = write_reports(run.frames, str(tmp_path / "out"))
    again = spark.read.option("header", True).csv(written["store_validation"])
    assert again.count() == 4 and "Units_Diff_%" in again.columns
    run.release()


def test_reconcile_rules_and_summary_review(spark):
    bau, test = (spark.createDataFrame(r, NAMES) for r in (ROWS, TEST_ROWS))
    rules = ValidationConfig()
    rules.item_validation.enabled = rules.compare_store_list.enabled = False
    rules.store_validation.enabled = False
    run = reconcile(bau, test, CONFIG, CONFIG, rules, file_counts=(["a.csv"], ["b.csv", "c.csv"]))
    assert set(run.frames) == {"bau_review", "test_review"}
    assert tuple(run["bau_review"].first()) == ("a.csv", 3, 3, 43.0, 429.57)
    assert run["test_review"].first()["filename"] == "2 files (aggregated)"
    run.release()


@pytest.mark.parametrize("level,frames", [
    ("store_validation", {"store_validation"}), ("item_validation", {"item_comparison", "item_summary"}),
])
def test_reconcile_one_level_only(spark, level, frames):
    bau, test = (spark.createDataFrame(r, NAMES) for r in (ROWS, TEST_ROWS))
    rules = ValidationConfig()
    for name in RULE_NAMES:
        getattr(rules, name).enabled = name == level
    run = reconcile(bau, test, CONFIG, CONFIG, rules)
    assert set(run.frames) == frames and all(f.count() > 0 for f in run.frames.values())
    assert run.metrics()["test"]["rows"] == 5
    run.release()


def test_bad_measures_are_counted(spark):
    bau = spark.createDataFrame([*ROWS, ("S9", "1", "x", "N/A", "1")], NAMES)
    run = reconcile(bau, bau, CONFIG, CONFIG)
    run["store_validation"].collect()
    assert run.metrics()["bau"] == {"rows": 5, "bad_measures": 1, "no_store": 0}
    run.release()


def test_onboard(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Store\nS001\nS002\nS009\n")
    df = spark.createDataFrame(ROWS, NAMES)
    run = onboard(df, CONFIG, read_store_list(spark, str(tmp_path / "s.csv")), files=["r.csv"])
    assert sorted(map(tuple, run["store_list"].collect())) == [
        ("missing_in_prod", "s009"), ("missing_in_test", "s003"),
    ]
    assert sorted(rounded(run["upc_summary"])) == GOLDEN["item"]
    assert tuple(run["file_review"].first()) == ("r.csv", 3, 3, 43.0, 429.57)
    with pytest.raises(ValueError, match="store list"):
        onboard(df, CONFIG)
    run.release()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    write_report(df, str(tmp_path / "p"), OutputConfig(format="parquet"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    with pytest.raises(ValueError):
        write_report(df, str(tmp_path / "x"), "excel")


def test_profile(spark, tmp_path):
    for fmt, (writer, _) in FORMATS.items():
        (tmp_path / f"{fmt}.txt").write_text(writer(ROWS))
    (tmp_path / "plain.txt").write_text("ABCDEF123\nGHIJKL456\n")
    (tmp_path / "words.txt").write_text("line1\nline2\nline3\n")
    (tmp_path / "slash.txt").write_text("a \\\n" * 5)
    (tmp_path / "book.xlsx").write_text("PK,\n")
    (tmp_path / "numbers.csv").write_text("123|456|789\n")
    (tmp_path / "utf8.csv").write_bytes('Item Name;Qty;Flag;Amt\n"café;x";1;true;1.5\n"b";2;false;2\n'.encode())
    (tmp_path / "cp.csv").write_bytes("a\tb\ncafé\t\n".encode("cp1252"))
    got = {r["filename"]: r for r in profile_files(spark, str(tmp_path)).collect()}
    assert len(got) == 11

    def kind(name):
        r = got[name]
        return r["file_type"], r["delimiter"], r["has_header"]

    assert kind("delimited.txt") == ("delimited", ",", True)
    assert kind("fixed.txt")[:2] == ("fixed", None)
    assert kind("plain.txt")[0] == kind("words.txt")[0] == "fixed"
    assert kind("multiline.txt") == ("multiline", "|", False)
    assert got["multiline.txt"]["record_types"] == ["D", "H"]
    assert kind("hdr_fixed.txt")[0] == "multiline"
    assert got["hdr_fixed.txt"]["header_prefix"] == "HDR"
    assert kind("slash.txt")[0] == "multiline"
    assert kind("book.xlsx")[0] == "excel"
    assert kind("numbers.csv") == ("delimited", "|", False)
    assert got["utf8.csv"]["encoding"] == "utf-8" and got["cp.csv"]["encoding"] == "cp1252"
    d = got["delimited.txt"]
    assert d["columns"] == NAMES
    assert d["data_types"] == ["String", "Int64", "String", "Int64", "Float64"]
    assert [d[c] for c in ROLES] == list(ROLES.values())
    assert got["utf8.csv"]["columns"] == ["Item Name", "Qty", "Flag", "Amt"]
    assert got["utf8.csv"]["data_types"] == ["String", "Int64", "Boolean", "Float64"]
    assert got["multiline.txt"]["columns"] == [f"Column_{i}" for i in range(5)]
    config = config_from_profile(d)
    assert validate_config(spark, config) == []
    df = read_pos(spark, str(tmp_path / "delimited.txt"), config)
    assert sorted(rounded(aggregate(df, "store", config))) == GOLDEN["store"]


def test_profile_reads_whole_files(spark, small_splits, tmp_path):
    rows = "".join(f"{i},{i % 7},1.5,a\n" for i in range(300))
    (tmp_path / "late.csv").write_text("Store,UPC,Price,Name\n" + rows + "300,n/a,2,b\n")
    (tmp_path / "cp.csv").write_bytes(("Store,UPC\n" + "é,1\n" * 200).encode() + "é,2\n".encode("cp1252"))
    (tmp_path / "utf.csv").write_bytes(("Store,UPC\n" + "e,1\n" * 200 + "é,1\n").encode())
    (tmp_path / "kinds.txt").write_text("H|S1|x\n" + "D|1|2\n" * 80 + "T|1|2|3|4\n")
    (tmp_path / "wide.txt").write_text("Store 1   milk  12\n" * 150 + "Store 2   a,b,c  3\n")
    (tmp_path / "one.csv").write_text("A,1\nstore,2\n" + "store,3\n" * 100 + "B,4\n")
    got = {r["filename"]: r for r in profile_files(spark, str(tmp_path)).collect()}
    assert got["late.csv"]["columns"] == ["Store", "UPC", "Price", "Name"]
    assert got["late.csv"]["data_types"] == ["Int64", "String", "Float64", "String"]
    assert got["cp.csv"]["encoding"] == "cp1252" and got["utf.csv"]["encoding"] == "utf-8"
    assert got["kinds.txt"]["record_types"] == ["D", "H", "T"]
    assert got["kinds.txt"]["columns"] == [f"Column_{i}" for i in range(4)]
    assert got["wide.txt"]["file_type"] == "fixed" and got["one.csv"]["file_type"] == "delimited"


def test_suggest_mapping(spark):
    cases = [
        (["Loc", "UPC Code", "Item Description", "Qty Sold", "Total Price"],
         ["Loc", "UPC Code", "Item Description", "Qty Sold", "Total Price"]),
        (["price", "STORE ", "barcode", "name", "sold"], ["STORE ", "barcode", "name", "sold", "price"]),
        (["x1", "x2"], ["x1"] * 5),
    ]
    df = spark.createDataFrame([(c,) for c, _ in cases], "columns array<string>")
    got = suggest_mapping(df).collect()
    for (_, expected), row in zip(cases, got):
        assert list(row)[1:] == expected


def test_mapping_errors(spark):
    df = spark.createDataFrame(
        [("a", "b", "c", "d", "e"), ("a", "a", None, "", "a")],
        "store_col string, upc_col string, desc_col string, units_col string, price_col string",
    )
    good, bad = (r["errors"] for r in check_mapping(df).collect())
    assert good == []
    assert bad == [
        "Description column is not selected.",
        "Units column is not selected.",
        "Duplicate column: 'a' is selected for both 'Store' and 'UPC'. Each column must be unique.",
        "Duplicate column: 'a' is selected for both 'UPC' and 'Price'. Each column must be unique.",
    ]


def test_config_audit(spark, tmp_path):
    good = FormatConfig(file_type="delimited", schema=NAMES, **ROLES)
    save_format_config(good, str(tmp_path / "good.json"))
    (tmp_path / "bad.json").write_text(json.dumps({"file_type": "fixed", "schema": ["a"], "store_col": "z"}))
    (tmp_path / "hdr.json").write_text(json.dumps({"file_type": "multiline", "header_prefix": "HDR"}))
    got = {r["source_file"].rsplit("/", 1)[-1]: r["errors"] for r in audit_configs(spark, str(tmp_path)).collect()}
    assert got["good.json"] == []
    assert got["bad.json"] == [
        "Fixed-width files require a layout CSV file path.", "UPC column mapping is required.",
        "Units column mapping is required.", "Price column mapping is required.",
        "Mapped columns not found in schema: z",
    ]
    assert got["hdr.json"][:2] == [
        "HDR files require a header layout CSV.", "HDR files require a detail layout CSV.",
    ]
    with pytest.raises(ValueError):
        assert_config_valid(spark, FormatConfig())


def test_config_round_trip_and_layouts(spark, tmp_path):
    (tmp_path / "layouts").mkdir()
    (tmp_path / "layouts" / "l.csv").write_text("From,Length,Field,Type\n1,6,Store,text\n")
    config = FormatConfig(name="n", file_type="fixed", layout_file="layouts/l.csv", implied_units=True)
    config.validation_config.store_validation.enabled = False
    config.output_config.format = "parquet"
    path = str(tmp_path / "c.json")
    save_format_config(config, path)
    back = load_format_config(path)
    assert back == config
    resolved = resolve_layouts(spark, back, str(tmp_path))
    assert [f.field for f in resolved.layout] == ["Store"]
    partial = config_from_dict({"file_type": "fixed", "layout_file": "layouts/test.csv"})
    assert (partial.version, partial.encoding, partial.ml_delimiter, partial.has_header) == (2, "cp1252", "|", True)


def test_history(spark, tmp_path):
    path = str(tmp_path / "h")
    for i in range(12):
        record_run(spark, path, files_processed=i, timestamp=datetime.datetime(2024, 1, 1 + i))
    assert [r["files_processed"] for r in last_runs(spark, path).collect()] == list(range(11, 1, -1))


@pytest.mark.parametrize("fmt", ["delimited", "fixed", "multiline"])
def test_landing_stream(spark, tmp_path, fmt):
    writer, config = FORMATS[fmt]
    (tmp_path / "a.txt").write_text(writer(ROWS[:2]))
    config = config.with_(schema=NAMES)
    stream = stream_summary(spark, str(tmp_path), config, "store")
    query = stream.writeStream.format("memory").queryName(f"landing_{fmt}").outputMode("complete").start()
    try:
        query.processAllAvailable()
        (tmp_path / "b.txt").write_text(writer(ROWS[2:]))
        query.processAllAvailable()
        assert sorted(rounded(spark.table(f"landing_{fmt}"))) == GOLDEN["store"]
    finally:
        query.stop()


def test_stream_refuses_ordered_formats(spark, tmp_path):
    with pytest.raises(ValueError):
        stream_summary(spark, str(tmp_path), FORMATS["hdr_fixed"][1], "store")


def test_metrics_without_a_report_is_an_error(spark):
    df = spark.createDataFrame([("S1", "1", "W", "10", "x")], NAMES)
    run = reconcile(df, df, CONFIG, CONFIG)
    with pytest.raises(ValueError, match="computed"):
        run.metrics(timeout=0.2)
    run["store_validation"].count()
    assert run.metrics()["bau"]["bad_measures"] == 1
    run.release()


def test_options_of_a_configuration_reach_the_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Store,UPC,Description,Units,Price\nS1,1,"two\nlines",2,3\nS2,2\n')
    config = CONFIG.with_(quoted_newlines=True, pad_ragged=True)
    rows = sorted(map(tuple, read_pos(spark, str(tmp_path), config).collect()))
    assert rows == [("S1", "1", "two\nlines", "2", "3"), ("S2", "2", "", "", "")]
    (tmp_path / "a.csv").write_text('top\nStore,UPC,Description,Units,Price\nS1,1,"two\nlines",2,3\nS2,2\n')
    below = read_pos(spark, str(tmp_path), config.with_(start_line=1, mixed_headers=True))
    assert sorted(map(tuple, below.collect())) == rows


def test_stream_decodes_like_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes("Store,UPC,Description,Units,Price\nCafé,1,W,2,3\n".encode("cp1252"))
    config = CONFIG.with_(schema=["Store", "UPC", "Description", "Units", "Price"])
    stream = stream_summary(spark, str(tmp_path / "in"), config, "store")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("decoded").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = aggregate(read_pos(spark, str(tmp_path / "in"), config), "store", config)
    assert [r[0] for r in spark.table("decoded").collect()] == [r[0] for r in batch.collect()] == ["Café"]


def test_configuration_from_any_store(spark, tmp_path):
    save_format_config(CONFIG.with_(name="x", pad_ragged=True), str(tmp_path / "c.json"))
    assert load_format_config(f"file://{tmp_path}/c.json", spark) == load_format_config(str(tmp_path / "c.json"))
