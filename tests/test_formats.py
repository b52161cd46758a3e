"""Every format gives the same summaries; readers follow their line rules."""

import gzip
import random

import pytest

from posrecon.config import LayoutField
from posrecon.operators.summarize import aggregate
from posrecon.sources.delimited import list_files, read_delimited
from posrecon.sources.dispatch import read_pos
from posrecon.sources.fixed import read_fixed_width
from posrecon.sources.layout import load_layout
from posrecon.sources.lines import LINE_NO, head_lines, number_lines, read_lines
from posrecon.sources.preview import preview_raw, preview_records, preview_transactions
from posrecon.sources.records import read_records
from posrecon.sources.tables import read_csv_tolerant, read_store_list
from posrecon.sources.transactions import read_transactions
from tests.fixtures import (
    DETAIL_LAYOUT,
    FORMATS,
    GOLDEN,
    HEADER_LAYOUT,
    ROWS,
    delimited_text,
    fixed_text,
    records_text,
    rounded,
)

HDR = [LayoutField("store", 6, 13)]
DTL = [LayoutField("item", 6, 12)]


@pytest.mark.parametrize("fmt", FORMATS)
@pytest.mark.parametrize("level", GOLDEN)
def test_golden(spark, tmp_path, fmt, level):
    writer, config = FORMATS[fmt]
    (tmp_path / "in.txt").write_text(writer(ROWS))
    got = rounded(aggregate(read_pos(spark, str(tmp_path), config), level, config))
    assert sorted(got) == GOLDEN[level]


def test_unknown_level_and_type(spark, tmp_path):
    writer, config = FORMATS["delimited"]
    (tmp_path / "in.txt").write_text(writer(ROWS))
    df = read_pos(spark, str(tmp_path), config)
    with pytest.raises(ValueError):
        aggregate(df, "region", config)
    with pytest.raises(ValueError):
        read_pos(spark, str(tmp_path), config.with_(file_type="excel"))


@pytest.mark.parametrize("sep", ["|", "\t", ";"])
def test_delimiters(spark, tmp_path, sep):
    (tmp_path / "in.txt").write_text(delimited_text(ROWS, sep))
    assert read_delimited(spark, str(tmp_path), sep).count() == 4


def test_delimited_ragged_quotes_and_header_only(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('a,b\n1,2\nbad\ntoo,many,cols\n"x,1","say ""hi"""\n')
    assert [tuple(r) for r in read_delimited(spark, str(f), pad_ragged=True).collect()] == [
        ("1", "2"), ("bad", ""), ("too", "many"), ("x,1", 'say "hi"'),
    ]
    f.write_text("a,b,c\n")
    empty = read_delimited(spark, str(f))
    assert empty.columns == ["a", "b", "c"] and empty.count() == 0


def test_headers_must_agree_or_are_matched_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a\n3,4\n")
    with pytest.raises(Exception, match="header"):
        read_delimited(spark, str(tmp_path)).collect()
    got = read_delimited(spark, str(tmp_path), mixed_headers=True)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [("1", "2"), ("4", "3")]


def test_odd_file_names(spark, tmp_path):
    (tmp_path / "a [1] {x}%20é+.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b c.csv").write_text("b,a\n3,4\n")
    got = read_delimited(spark, str(tmp_path), mixed_headers=True)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [("1", "2"), ("4", "3")]
    names = [r["filename"] for r in list_files(spark, str(tmp_path)).collect()]
    assert sorted(names) == ["a [1] {x}%20é+.csv", "b c.csv"]


def test_gzip_and_crlf(spark, tmp_path):
    for fmt, (writer, config) in FORMATS.items():
        with gzip.open(tmp_path / f"{fmt}.txt.gz", "wt", newline="") as f:
            f.write(writer(ROWS).replace("\n", "\r\n"))
        df = read_pos(spark, str(tmp_path / f"{fmt}.txt.gz"), config)
        assert sorted(rounded(aggregate(df, "item", config))) == GOLDEN["item"]


def test_delimited_start_line(small_splits, tmp_path):
    for i in range(3):
        body = "".join(f"S{i},{j}\n" for j in range(300))
        (tmp_path / f"f{i}.csv").write_text(f"banner {i}\nsecond\nStore,Units\n{body}")
    df = read_delimited(small_splits, str(tmp_path), start_line=2)
    assert df.columns == ["Store", "Units"]
    assert sorted(tuple(r) for r in df.collect()) == sorted(
        (f"S{i}", str(j)) for i in range(3) for j in range(300)
    )
    named = read_delimited(
        small_splits, str(tmp_path), start_line=3, has_header=False, column_names=["s", "u"]
    )
    assert named.columns == ["s", "u"] and named.count() == 900


def test_encodings(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("col1\ncafé €\n".encode("utf-8"))
    (tmp_path / "c.csv").write_bytes("col1\ncafé €\n".encode("cp1252"))
    for name in ("u.csv", "c.csv"):
        assert read_csv_tolerant(spark, str(tmp_path / name)).first()[0] == "café €"
    (tmp_path / "bad.txt").write_bytes(b"a\x81b\xe9\n")
    assert read_lines(spark, str(tmp_path / "bad.txt")).first()["value"] == "abé"
    assert read_lines(spark, str(tmp_path / "u.csv"), "utf-8").collect()[1]["value"] == "café €"


def test_empty_csv(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert read_csv_tolerant(spark, str(tmp_path / "e.csv")).count() == 0


def test_store_list_keeps_leading_zeros(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Store\n00238\n")
    assert read_store_list(spark, str(tmp_path / "s.csv")).first()["Store"] == "00238"


def test_missing_input_raises(spark, tmp_path):
    with pytest.raises(Exception):
        read_lines(spark, str(tmp_path / "none.txt")).count()


def test_layout_file(spark, tmp_path):
    f = tmp_path / "l.csv"
    f.write_text("From,Length,Field,Type\n1,6,Store,text\n7,10,UPC,Numeric\n")
    assert load_layout(spark, str(f)) == [
        LayoutField("Store", 0, 6, "text"), LayoutField("UPC", 6, 16, "numeric"),
    ]
    f.write_text("field,from,length\nStore,2,3\n")
    assert load_layout(spark, str(f)) == [LayoutField("Store", 1, 4, "text")]


def test_fixed_record_type_and_types(spark, tmp_path):
    f = tmp_path / "f.txt"
    f.write_text("XSKIP\nU000123 240115\nU      20240115\n\n")
    layout = [LayoutField("n", 1, 7, "numeric"), LayoutField("d", 8, 14, "date")]
    got = [tuple(r) for r in read_fixed_width(spark, str(f), layout, record_type="U").collect()]
    assert got == [("123", "2024-01-15"), ("0", "2002-40-11")]
    assert read_fixed_width(spark, str(f), layout).count() == 4


def test_fixed_start_line_across_blocks(small_splits, tmp_path):
    (tmp_path / "f.txt").write_text("".join(f"{i:05d}\n" for i in range(1000)))
    got = read_fixed_width(small_splits, str(tmp_path), [LayoutField("v", 0, 5)], start_line=150)
    assert sorted(r[0] for r in got.collect()) == [f"{i:05d}" for i in range(150, 1000)]


def test_line_numbers_and_heads(small_splits, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(500)))
    lines = read_lines(small_splits, str(tmp_path), ordered=True)
    assert lines.select("__block").distinct().count() > 5
    numbered = number_lines(lines).select("value", LINE_NO).collect()
    assert len(numbered) == 1000 and all(r[0][1:] == str(r[1]) for r in numbered)
    head = head_lines(lines, 120).collect()
    assert len(head) == 240 and all(r["value"][1:] == str(r[LINE_NO]) for r in head)


def test_records_width_and_padding(spark, tmp_path):
    f = tmp_path / "m.txt"
    f.write_text("H|S1|2024\r\nD|S1|1|a|2|3\r\n\r\nT|9\r\nD\r\nHX\r\n")
    df = read_records(spark, str(f), ["H", "D"])
    assert df.columns == [f"Column_{i}" for i in range(5)]
    assert [tuple(r) for r in df.collect()] == [
        ("S1", "2024", "", "", ""), ("S1", "1", "a", "2", "3"), ("X", "", "", "", ""),
    ]
    with pytest.raises(Exception, match="column names"):
        read_records(spark, str(f), ["D"], column_names=["a", "b"]).collect()


def test_transactions_small_cases(spark, tmp_path):
    f = tmp_path / "t.txt"

    def run(text, trailer=None, layout=None):
        f.write_text(text)
        df = read_transactions(spark, str(f), "HDR", HDR, DTL, trailer, layout)
        return df.columns, sorted((tuple(r) for r in df.collect()), key=str)

    assert run("HDR001Store 1\nDTL001Item A\nDTL002Item B\nHDR002Store 2\nDTL003Item C\n") == (
        ["store", "item"], [("Store 1", "Item A"), ("Store 1", "Item B"), ("Store 2", "Item C")],
    )
    one = [LayoutField("total", 9, 12, "numeric")]
    assert run("HDR001Store 1\nDTL001Item A\nDTL002Item B\nTRL001   100\n", "TRL", one)[1] == [
        ("Store 1", "Item A", "100"), ("Store 1", "Item B", "100"),
    ]
    open_end = "HDR001Store 1\nDTL001Item A\nTRL001   100\nHDR002Store 2\nDTL002Item B\n"
    assert run(open_end, "TRL", one)[1] == [
        ("Store 1", "Item A", "100"), ("Store 2", "Item B", None),
    ]
    assert run("HDR001Store 1\nDTL001Item A\nTRL001   100\n", "TRL") == (
        ["store", "item"], [("Store 1", "Item A")],
    )
    # Without a trailer prefix the trailer line is a detail.
    assert len(run("HDR001Store 1\nDTL001Item A\nTRL001   100\n")[1]) == 2
    # Orphans: before any header, and between trailer and next header.
    orphans = "DTL000Lost  \nHDR001Store 1\nDTL001Item A\nTRL001   100\nDTL002Lost  \n"
    assert run(orphans, "TRL", one)[1] == [("Store 1", "Item A", "100")]
    with pytest.raises(ValueError):
        read_transactions(spark, str(f), "HDR", HDR, None)


def test_transactions_field_precedence(spark, tmp_path):
    f = tmp_path / "t.txt"
    f.write_text("HDRa1\nDTLb2\nTRLc3\nHDRa1\nDTLb2\n")
    same = [LayoutField("x", 3, 4), LayoutField("y", 4, 5)]
    only_x = [LayoutField("x", 3, 4)]
    df = read_transactions(spark, str(f), "HDR", same, only_x, "TRL", only_x)
    assert sorted(tuple(r) for r in df.collect()) == [("b", "1"), ("c", "1")]


def _sequential(lines, trailer):
    """Plain model of the reading rules."""
    out, buffer, header = [], [], None
    for line in lines:
        if not line:
            continue
        if line.startswith("HDR"):
            header = line[3:9].strip()
        elif trailer and line.startswith("TRL"):
            out += [(h, d, line[3:9].strip()) for h, d in buffer]
            buffer, header = [], None
        elif header is not None:
            buffer.append((header, line[3:9].strip()))
    return out + [(h, d, None) for h, d in buffer]


@pytest.mark.parametrize("trailer", [True, False])
@pytest.mark.parametrize("weights", [(1, 6, 1), (1, 200, 1), (3, 3, 2)])
def test_transactions_against_model(small_splits, tmp_path, trailer, weights):
    rng = random.Random(sum(weights) + trailer)
    expected = []
    for name in ("a", "b", "c"):
        lines = []
        for i in range(1500):
            kind = rng.choices(["HDR", "DTL", "TRL"], weights)[0]
            lines.append("" if rng.random() < 0.02 else f"{kind}{name}{i:05d}")
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n")
        expected += _sequential(lines, trailer)
    field = [LayoutField("h", 3, 9)], [LayoutField("d", 3, 9)], [LayoutField("t", 3, 9)]
    df = read_transactions(
        small_splits, str(tmp_path), "HDR", field[0], field[1],
        "TRL" if trailer else None, field[2] if trailer else None,
    )
    got = [tuple(r) if trailer else (*r, None) for r in df.collect()]
    key = lambda r: tuple(x or "" for x in r)
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_previews(spark, tmp_path):
    f = tmp_path / "in.txt"
    f.write_text(delimited_text(ROWS))
    got = preview_raw(spark, str(f), "delimited", ",", n_rows=3)
    assert got.columns == ["Store", "UPC", "Description", "Units", "Price"] and got.count() == 2
    f.write_text(fixed_text(ROWS))
    layout = FORMATS["fixed"][1].layout
    assert preview_raw(spark, str(f), "fixed", layout=layout, n_rows=2).count() == 2
    assert preview_raw(spark, str(f), "fixed", layout=layout, start_line=3).first()["Store"] == "S003"
    f.write_text(records_text(ROWS))
    assert preview_raw(spark, str(f), "multiline", n_rows=5).count() == 5
    assert preview_records(spark, str(f), ["D"], n_rows=3).count() == 3
    f.write_text(FORMATS["hdr_fixed"][0](ROWS))
    shown = preview_transactions(spark, str(f), "HDR", HEADER_LAYOUT, DETAIL_LAYOUT, 2, "TRL")
    assert [r["Description"] for r in shown.collect()] == ["Widget A", "Gadget B"]
