"""The raw files that queries are run on: whole, in order, and written without one task that holds all lines."""

import datetime
import gzip
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from posrecon.catalog import sides
from posrecon.config import LayoutField
from posrecon.plans import profile
from posrecon.sources import lines as lines_
from posrecon.sources.dispatch import read_pos
from posrecon.sources.lines import BLOCK, FILE_ID, read_lines
from posrecon.sources.quoted import quoted_records
from posrecon.sources.transactions import read_transactions


def _sales(spark, n, seed=3):
    rng = random.Random(seed)
    day = datetime.datetime(2020, 1, 1)
    # The narrow key range has more lines per order than a text holds, the wide one fewer.
    keys = [rng.choice((rng.randint(-3, 3), rng.randint(0, 10**6), None)) for _ in range(n)]
    rows = [
        (k, rng.randint(1, 50), rng.randint(1, 9), rng.choice((None, *range(1, 8))), float(rng.randint(1, 50)), rng.randint(100, 99999) / 100,
         rng.choice(("A", "R\x01", "\x02a     N", "N")), rng.choice("FO"), day + datetime.timedelta(rng.randint(0, 400)))
        for k in keys
    ]
    return spark.createDataFrame(
        rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp"
    ).repartition(7)


def _in_parts(spark, path):
    """Part -> lists of lines, one per file, with the lines of a file in order."""
    files = defaultdict(list)
    lines = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("f")).collect()
    for text, name in lines:
        files[name.split("part=")[1].split("/")[0]].append(text.split("\n")[:-1])
    return files


def test_files_in_order(spark, tmp_path):
    n = 9000
    _sales(spark, n).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = sides.bau(spark, str(tmp_path)).collect()
    path = sides.raw_files(spark, str(tmp_path), "bau", "ordered_fixed")
    want = defaultdict(list)
    for r in rows:
        line = f"{r.Store:<12}{r.UPC:>14}{r.Description:<30}{int(r.Units):>6}{r.Price:>14.2f}"
        part = None if r.OrderKey is None else (abs(r.OrderKey) % 5) * (1 if r.OrderKey >= 0 else -1)
        key = "__HIVE_DEFAULT_PARTITION__" if part is None else str(part)
        want[key].append((r.OrderKey or 0, r.LineNumber or 0, line))
    found = _in_parts(spark, path)
    assert {k: [len(x) for x in v] for k, v in found.items()} == {k: [len(v)] for k, v in want.items()}
    for k, v in want.items():
        assert found[k][0] == [x[2] for x in sorted(v)]
    # Only the kind that was asked for is written.
    assert spark.read.text(path).count() == n


def test_headers_lead_and_transactions_are_whole(spark, tmp_path):
    _sales(spark, 4000).where("l_orderkey >= 0 and l_linenumber is not null").write.parquet(f"{tmp_path}/lineitem.parquet")
    delimited = _in_parts(spark, sides.raw_files(spark, str(tmp_path), "bau", "ordered_delimited"))
    assert len(delimited) == 5 and all(len(v) == 1 for v in delimited.values())
    for (lines,) in delimited.values():
        assert lines[0] == ",".join(sides.RAW) and lines.count(lines[0]) == 1
    for (lines,) in _in_parts(spark, sides.raw_files(spark, str(tmp_path), "bau", "ordered_transactions")).values():
        heads = [i for i, x in enumerate(lines) if x.startswith("HDR")]
        ends = [i for i, x in enumerate(lines) if x.startswith("TRL")]
        assert heads == [0, *(i + 1 for i in ends[:-1])] and ends[-1] == len(lines) - 1
        orders = [int(lines[i][3:15]) for i in heads]
        assert orders == sorted(set(orders))


@pytest.fixture
def four_lines(monkeypatch):
    """Pieces of four lines, so that one block has many."""
    monkeypatch.setattr(lines_, "PIECE_BITS", 2)


def test_state_crosses_the_pieces_of_a_block(spark, tmp_path, four_lines):
    text = ["D early"]
    for k in range(9):
        text += [f"HDR{k}", *(f"D{k}{i}" for i in range(k)), f"TRL{k}", "D late"]
    (tmp_path / "t.txt").write_text("\n".join(text) + "\n")
    pieces = lines_.in_pieces(read_lines(spark, str(tmp_path / "t.txt"), ordered=True))
    assert pieces.select(FILE_ID, BLOCK).distinct().count() == -(-len(text) // 4)
    rows = read_transactions(
        spark, str(tmp_path / "t.txt"), "HDR", [LayoutField("h", 3, 4)], [LayoutField("d", 1, 3)], "TRL", [LayoutField("t", 3, 4)],
        with_position=True,
    )
    assert dict(rows.dtypes)[BLOCK] == "bigint"
    assert sorted((r.h, r.d, r.t) for r in rows.collect()) == [(str(k), f"{k}{i}", str(k)) for k in range(9) for i in range(k)]


def test_quoted_cells_cross_the_pieces_of_a_block(spark, tmp_path, four_lines):
    records = [f'{k},"' + "\n".join(f"x{i}" for i in range(k + 1)) + '"' for k in range(12)] + ["plain,1"] * 6
    (tmp_path / "q.csv").write_text("\n".join(records) + "\n")
    found = quoted_records(read_lines(spark, str(tmp_path / "q.csv"), ordered=True), ",")
    assert sorted(r.value for r in found.collect()) == sorted(records)


def test_profile_sorts_no_lines(spark, tmp_path):
    (tmp_path / "p.csv").write_text('a,b,c,d,e,f,g\n1,2.5,true,x,,"1,5",7\n2,3,FALSE,y,,2,8\n')
    lines = profile._lines(spark, str(tmp_path / "p.csv"))
    assert "SortAggregate" not in profile._counts(lines)._jdf.queryExecution().toString()
    row = profile.profile_files(spark, str(tmp_path / "p.csv")).first()
    assert row["columns"] == list("abcdefg") and row["has_header"]
    assert row["data_types"] == ["Int64", "Float64", "Boolean", "String", "String", "String", "Int64"]


@pytest.mark.parametrize("kind", ["delimited", "fixed"])
def test_plain_sales_files_are_compressed_and_of_bounded_length(spark, tmp_path, monkeypatch, kind):
    """a third of the bytes of their text at most, several files, and every row."""
    monkeypatch.setattr(sides, "COMPRESSED", sides.COMPRESSED | {"maxRecordsPerFile": 300})
    _sales(spark, 3000).write.parquet(str(tmp_path / "lineitem.parquet"))
    path = str(tmp_path / "out")
    rows = sides.bau(spark, str(tmp_path)).fillna("S0", ["Store"]).withColumn("Description", F.translate("Description", "\x01\x02", ""))
    sides._WRITERS[kind](rows, path)
    files = list((tmp_path / "out").glob("part-*"))
    texts = [gzip.decompress(f.read_bytes()) for f in files]
    assert all(f.suffix == ".gz" for f in files) and max(t.count(b"\n") for t in texts) <= 301
    assert sum(f.stat().st_size for f in files) * 3 <= sum(map(len, texts))
    read = read_pos(spark, path, sides.CONFIGS[kind]).select(*[F.trim(c).alias(c) for c in sides.RAW[:3]], F.col("Units").cast("double"), F.col("Price").cast("double"))
    want = rows.select(*[F.trim(c).alias(c) for c in sides.RAW[:3]], "Units", "Price")
    assert read.exceptAll(want).isEmpty() and want.exceptAll(read).isEmpty()
