"""A summary that grows file by file, and previews that stop early."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from posrecon.operators.summarize import summarize_level
from posrecon.sources import preview
from posrecon.sources.lines import FILE
from posrecon.sources.preview import preview_raw, preview_records, preview_transactions
from posrecon.streaming.landing import stream_into
from posrecon.streaming import summary_table
from posrecon.streaming.summary_table import SummaryTable
from tests.fixtures import FORMATS, NAMES
from tests.test_formats import DTL, HDR
from posrecon.config import LayoutField


def sales(spark, files):
    """Canonical item rows of (file, [(upc, units), ...])."""
    rows = [(f, u, "d", float(n), n / 4) for f, items in files for u, n in items]
    return spark.createDataFrame(rows, f"{FILE} string, UPC_CODE string, PRODUCT_DESCRIPTION string, UNITS_SOLD double, TOTAL_DOLLARS double")


def test_only_touched_buckets_are_rewritten_and_replays_change_nothing(spark, tmp_path):
    table = SummaryTable(spark, str(tmp_path / "t"), "item", buckets=32)
    first = sales(spark, [("a", [(f"u{i}", i) for i in range(200)]), ("b", [("u1", 5), (None, 2)])])
    wrote = table.add(first)
    assert len(wrote) == 32 and table.read().count() == 201
    assert table.add(first) == [] and table.add(first.limit(0)) == []
    second = sales(spark, [("b", [("u1", 5)]), ("c", [("u1", 7), ("new", 1)])])
    again = table.add(second)
    assert 0 < len(again) <= 2 and Counter(table.versions().values()) == {1: 32 - len(again), 2: len(again)}
    want = summarize_level(first.unionByName(second.where(f"{FILE} = 'c'")), "item", True)
    assert Counter(map(tuple, table.read().collect())) == Counter(map(tuple, want.collect()))
    assert {tuple(r) for r in table.files().collect()} == {("a", 1), ("b", 1), ("c", 2)}


def test_a_failed_attempt_is_not_read(spark, tmp_path):
    table = SummaryTable(spark, str(tmp_path / "t"), "item", buckets=4)
    table.add(sales(spark, [("a", [("u", 1)])]))
    bucket = next(iter(table.versions()))
    left = sales(spark, [("x", [("u", 100)])]).drop(FILE)
    left.write.parquet(f"{tmp_path}/t/data/version=2/bucket={bucket}")
    assert table.read().first()["UNITS_SOLD"] == 1.0
    table.add(sales(spark, [("b", [("u", 2)])]))
    assert [tuple(r) for r in table.read().collect()] == [("u", "d", 3.0, 0.75)]
    empty_file = sales(spark, [("z", [])])
    assert table.add(empty_file) == []
    with pytest.raises(ValueError, match="level"):
        SummaryTable(spark, "x", "region")


def test_stream_into_a_growing_table(spark, tmp_path):
    folder, table = tmp_path / "in", SummaryTable(spark, str(tmp_path / "t"), "store", buckets=8)
    folder.mkdir()
    config = FORMATS["delimited"][1].with_(schema=NAMES)
    rows = lambda stores: ",".join(NAMES) + "\n" + "".join(f"{s},1,W,2,3.5\n" for s in stores)

    def run():
        writer = stream_into(spark, str(folder), config, table).option("checkpointLocation", str(tmp_path / "p"))
        writer.trigger(availableNow=True).start().awaitTermination()
        return {r[0]: r[1:] for r in table.read().collect()}

    (folder / "a.csv").write_text(rows(["S1", "S2"] * 3))
    assert run() == {"S1": (6.0, 10.5), "S2": (6.0, 10.5)}
    (folder / "b.csv").write_text(rows(["S2", "S3"]))
    assert run() == {"S1": (6.0, 10.5), "S2": (8.0, 14.0), "S3": (2.0, 3.5)}
    assert run()["S2"] == (8.0, 14.0)


def test_a_batch_costs_few_jobs_and_opens_few_logs(spark, tmp_path):
    table = SummaryTable(spark, str(tmp_path / "t"), "item", buckets=4)
    batches = [sales(spark, [(f"f{i}", [(f"u{k}", i + 1) for k in range(20)])]) for i in range(17)]
    for batch in batches[:16]:
        table.add(batch)
    tracker = spark.sparkContext.statusTracker()
    jobs = []
    for batch in (batches[16], batches[3]):
        group = f"add-{len(jobs)}-{tmp_path}"
        spark.sparkContext.setJobGroup(group, "")
        table.add(batch)
        jobs.append(len(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("", "")
    # 18 jobs for new files and 9 for known ones before, and a log folder for each of the 17 versions.
    assert jobs[0] <= 9 and jobs[1] <= 6, jobs
    assert len(table.files().inputFiles()) <= 3
    assert {r[1] for r in table.files().collect()} == set(range(1, 18))
    assert Counter(map(tuple, table.read().collect())) == {(f"u{k}", "d", 153.0, 38.25): 1 for k in range(20)}


def test_logs_are_read_in_blocks_or_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(summary_table, "_BLOCK", 2)
    path = str(tmp_path / "t")
    table, other = SummaryTable(spark, path, "upc", buckets=3), SummaryTable(spark, path, "upc", buckets=3)
    upcs = lambda f, u, n: sales(spark, [(f, [(u, n)])]).select(FILE, F.col("UPC_CODE").alias("UPC"), "UNITS_SOLD", "TOTAL_DOLLARS")
    for i in range(7):
        # Two writers take turns, and each sees what the other one wrote.
        (table, other)[i % 2].add(upcs(f"f{i}", f"u{i % 2}", 1))
        assert (table, other)[i % 2].add(upcs(f"f{max(0, i - 1)}", "u0", 100)) == []
    table._look()
    assert table._parts == [(0, 4), (4, 2), (6, 1)]
    ledger = {(f"f{i}", i + 1) for i in range(7)}

    def check(t, parts):
        assert {tuple(r) for r in t.files().collect()} == ledger and t.versions() == table.versions()
        assert t._parts == parts
        assert sorted(map(tuple, t.read().collect())) == [("u0", 4.0, 1.0), ("u1", 3.0, 0.75)]

    check(SummaryTable(spark, path, "upc", buckets=3), [(0, 4), (4, 2), (6, 1)])
    # What an attempt left behind that failed before its commit, and a block that was not written to its end.
    (tmp_path / "t/log/version=8/_temporary").mkdir(parents=True)
    (tmp_path / "t/log-blocks/1-4/_SUCCESS").unlink()
    check(SummaryTable(spark, path, "upc", buckets=3), [(0, 2), (2, 2), (4, 2), (6, 1)])
    ledger.add(("f7", 8))
    last = SummaryTable(spark, path, "upc", buckets=3)
    assert last.add(upcs("f7", "u2", 0)) and last.add(upcs("f0", "u2", 5)) == []
    assert {tuple(r) for r in last.files().collect()} == ledger and last._parts == [(0, 8)]


@pytest.mark.parametrize("few", [1000, 1])
def test_known_files_among_new_ones(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(summary_table, "_FEW", few)
    table = SummaryTable(spark, str(tmp_path / "t"), "item", buckets=16, exact=2)
    table.add(sales(spark, [("a'b %20\"c", [("u", 1), (None, 4)]), ("d", [("v", 2)])]))
    mixed = sales(spark, [("d", [("v", 2), ("only here", 9)]), ("e", [("u", 3), (None, 4)]), ("f", [("u", 5)]), (None, [("u", 50)])])
    wrote = table.add(mixed)
    assert len(wrote) == len([v for v in table.versions().values() if v == 2]) and 0 < len(wrote) <= 2
    assert Counter(map(tuple, table.read().collect())) == {("u", "d", 9.0, 2.25): 1, (None, "d", 8.0, 2.0): 1, ("v", "d", 2.0, 0.5): 1}
    assert {tuple(r) for r in table.files().collect()} == {("a'b %20\"c", 1), ("d", 1), ("e", 2), ("f", 2)}
    assert table.add(mixed.where(F.col(FILE).isNotNull())) == []


def test_previews_read_on_until_rows_are_complete(spark, tmp_path, monkeypatch):
    (tmp_path / "b.txt").write_text("never shown\n")
    (tmp_path / "a.txt").write_text("")
    body = ["DTL000orphan"] + ["HDR001Store 1"] + [f"DTL{i:03d}Item {i % 7}" for i in range(500)] + ["TRL001   100", "HDR002Store 2", "DTL001Item B"]
    (tmp_path / "aa.txt").write_text("\n".join(body) + "\n")
    total = [LayoutField("total", 9, 12, "numeric")]
    rows = preview_transactions(spark, str(tmp_path), "HDR", HDR, DTL, 3, "TRL", total).collect()
    assert [tuple(r) for r in rows] == [("Store 1", f"Item {i}", "100") for i in range(3)]
    monkeypatch.setattr(preview, "PREVIEW_LINES", 100)
    waiting = preview_transactions(spark, str(tmp_path), "HDR", HDR, DTL, 2, "TRL", total).collect()
    assert [tuple(r) for r in waiting] == [("Store 1", "Item 0", None), ("Store 1", "Item 1", None)]
    assert preview_transactions(spark, str(tmp_path), "HDR", HDR, DTL, 900).count() == 98
    monkeypatch.undo()
    assert [r[0] for r in preview_raw(spark, str(tmp_path), "multiline", n_rows=2).collect()] == body[:2]


def test_previews_of_sparse_and_short_files(spark, tmp_path):
    f = tmp_path / "f.txt"
    f.write_text("top\n" + "X\n" * 1000 + "Rab\n\nRcd\nH|1|\nHD\n")
    got = preview_raw(spark, str(f), "fixed", layout=[("v", 1, 3)], n_rows=5, start_line=1, record_type="R")
    assert [r[0] for r in got.collect()] == ["ab", "cd"]
    assert [tuple(r) for r in preview_records(spark, str(f), ["H", "Q"]).collect()] == [("1", ""), ("D", "")]
    f.write_text("a;b\n")
    assert preview_raw(spark, str(f), "delimited", ";").collect()[0].asDict() == {"column_0": "a", "column_1": "b"}
    f.write_text("")
    assert preview_raw(spark, str(f), "delimited").count() == 0
    with pytest.raises(ValueError, match="Unsupported"):
        preview_raw(spark, str(f), "excel")
