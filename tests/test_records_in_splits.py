"""Headers, line numbers and quoted line breaks in files that split."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from posrecon.sources import delimited, lines as ln
from posrecon.sources.delimited import column_names_of, read_delimited
from posrecon.sources.lines import LINE_NO, number_lines, read_lines
from posrecon.sources.quoted import quoted_records


def path_up(df, leaf):
    """For every leaf of that kind in the plan, the operators between it and the result."""
    rows = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    ).splitlines()
    depth = lambda row: len(row) - len(row.lstrip(" :+-*"))
    found = []
    for i, row in enumerate(rows):
        if leaf in row:
            up, d = [], depth(row)
            for above in reversed(rows[:i]):
                if 0 < depth(above) < d:
                    up.append(above.strip(" :+-*"))
                    d = depth(above)
            found.append(up)
    return found


def test_many_files_with_few_headers_in_one_scan(spark, tmp_path):
    headers = ["Store,UPC,Units", "Units,Store", "UPC,Extra,Store"]
    want = Counter()
    for i in range(500):
        names = headers[i % 3].split(",")
        rows = [{"Store": f"S{i}", "UPC": f"{j}", "Units": f"{i + j}", "Extra": "x"} for j in range(3)]
        (tmp_path / f"f{i:03d}.csv").write_text("\n".join([headers[i % 3], *(",".join(r[n] for n in names) for r in rows)]) + "\n")
        want.update(tuple(r[n] if n in names else None for n in ("Store", "UPC", "Units", "Extra")) for r in rows)
    df = read_delimited(spark, str(tmp_path), mixed_headers=True).select("Store", "UPC", "Units", "Extra")
    assert Counter(map(tuple, df.collect())) == want
    scans = path_up(df.select("*"), "FileScan text")
    assert len(scans) == 1 and not any(op.startswith("Exchange") for op in scans[0])


def test_a_file_without_its_columns_header_is_null_there_and_pads(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n\na,b\n1,2\n3\n")
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "c.csv").write_text("B,c\n4,5,6\n")
    got = read_delimited(spark, str(tmp_path), mixed_headers=True, with_file=True)
    assert got.columns == ["B", "c", "a", "source_file"]  # names match in any case, as columns do in Spark
    assert sorted(tuple(r)[:3] for r in got.fillna("-").collect()) == [("-", "-", "3"), ("2", "-", "1"), ("4", "5", "-")]


def test_names_of_headers():
    assert column_names_of('a,"b,c",,A,d', ",") == ["a0", "b,c", "_c2", "A3", "d"]
    assert column_names_of("a||b", "||") == ["a", "b"]


def test_a_late_header_is_an_error(small_splits, tmp_path, monkeypatch):
    monkeypatch.setattr(delimited, "HEAD_BYTES", 500)
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("\n" * 3000 + "a,b\n1,2\n")
    with pytest.raises(Exception, match="no header"):
        read_delimited(small_splits, str(tmp_path), mixed_headers=True).collect()


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_line_numbers_do_not_move_lines(small_splits, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(ln, "INDEX_ROWS", limit)
    for name in "abc":
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(700)))
    df = number_lines(read_lines(small_splits, str(tmp_path), ordered=True)).select("value", LINE_NO)
    got = df.collect()
    assert len(got) == 2100 and all(r[0][1:] == str(r[1]) for r in got)
    if limit:
        (up,) = path_up(df.select("*"), "FileScan text")
        assert any(op.startswith("BroadcastHashJoin") for op in up) and not any(op.startswith("Exchange") for op in up)


def model_records(text, delimiter=","):
    """Character by character: the records of one file."""
    records, held, inside = [], [], False
    for line in text.split("\n")[:-1] if text.endswith("\n") else text.split("\n"):
        i, at_start = 0, not inside
        while i < len(line):
            if inside:
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        i += 1
                    elif i + 1 == len(line) or line.startswith(delimiter, i + 1):
                        inside = False
            elif at_start and line[i] == '"':
                inside = True
                at_start = False
                i += 1
                continue
            elif line.startswith(delimiter, i):
                at_start = True
                i += len(delimiter)
                continue
            at_start = False
            i += 1
        held.append(line)
        if not inside:
            records.append("\n".join(held))
            held = []
    return records + (["\n".join(held)] if held else [])


def odd_text(seed):
    rnd = random.Random(seed)
    if seed % 3 == 0:
        return "".join(rnd.choice('ab",\n') for _ in range(3000))
    cell = lambda: rnd.choice(['"x\ny"', '"a""b"', "plain", '32" tv', '""', '"one, two\n\n""three"""', "é", '"' + "z\n" * rnd.randint(1, 400) + '"'])
    return "".join(",".join(cell() for _ in range(rnd.randint(1, 4))) + "\n" for _ in range(120))


@pytest.mark.parametrize("seed", range(9))
def test_records_equal_a_sequential_model(small_splits, tmp_path, seed):
    texts = [odd_text(10 * seed + k) for k in range(3)]
    for k, t in enumerate(texts):
        (tmp_path / f"{k}.csv").write_text(t)
    lines = read_lines(small_splits, str(tmp_path), "utf-8", ordered=True)
    assert lines.select("__block").distinct().count() > 5
    got = quoted_records(lines, ",").select(F.substring_index("source_file", "/", -1), "value").collect()
    want = [(f"{k}.csv", r) for k, t in enumerate(texts) for r in model_records(t)]
    assert Counter(map(tuple, got)) == Counter(want)


def test_quoted_mixed_and_start_line_together(small_splits, tmp_path):
    body = "".join(f'S{i},"first {i}\nsecond ""{i}"", end"\n' for i in range(200))
    (tmp_path / "a.csv").write_text("banner\nStore,Text\n" + body)
    (tmp_path / "b.csv").write_text("other\nText,Store\n" + '"x\ny",S900\n')
    df = read_delimited(small_splits, str(tmp_path), start_line=1, mixed_headers=True, quoted_newlines=True)
    want = [(f"S{i}", f'first {i}\nsecond "{i}", end') for i in range(200)] + [("S900", "x\ny")]
    assert sorted(tuple(r) for r in df.select("Store", "Text").collect()) == sorted(want)
    plain = read_delimited(small_splits, str(tmp_path / "a.csv"), start_line=2, has_header=False, quoted_newlines=True)
    assert plain.columns == ["_c0", "_c1"] and plain.count() == 200


def test_cells_are_decoded_one_by_one(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("näme,b\n".encode() + b"caf\xe9," + "é\n".encode())
    (tmp_path / "b.csv").write_bytes(b"b,c\n1,\x80\n")
    got = read_delimited(spark, str(tmp_path), encoding="auto", mixed_headers=True)
    assert sorted(map(tuple, got.select("näme", "b", "c").fillna("-").collect())) == [("-", "1", "€"), ("café", "é", "-")]
