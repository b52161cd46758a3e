"""The stages of the pipeline, each against what it was given."""

import re

import corpus_pipeline as p
from tests.llm.test_jaccard import brute
from tests.llm.test_line_dedup import cleaned
from tests.llm.test_secrets import base

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = [docs]
    for k, (_, stage) in enumerate(p.STAGES):
        out = f"{tmp_path}/{k}"
        stage(spark, steps[-1], SF).write.parquet(out)
        steps.append(spark.read.parquet(out))
    assert all(s.columns == columns for s in steps[:-1])
    given, good, lines, unlike, masked, packed = steps
    assert 0 < good.count() < given.count()
    assert set(rows(good)) <= set(rows(given))
    assert sorted(rows(lines)) == sorted((i, t) for i, _, _, t in cleaned(rows(good)))
    want = {i for i, n, c in brute(rows(lines), 5, 80, 100) if i == c}
    assert {i for i, _ in rows(unlike)} == want and set(rows(unlike)) <= set(rows(lines))
    for i, text in rows(masked):
        assert not base(text), text
    before = dict(rows(unlike))
    assert all(re.sub(r"\[SECRET\]", "", t) == t and t == before[i] for i, t in rows(masked) if not base(before[i]))
    assert all(r.n_chars == len(r.text) for r in masked.collect())
    assert {r.doc_id for r in packed.collect()} == want
    whole = p.run(spark, SF)
    assert {r[0] for r in whole.select("doc_id").distinct().collect()} == want


def test_names():
    assert [name for name, _ in p.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "secret scans", "packing"]


def test_odd_rows_and_empty_tables_through_all_stages(spark, frame, edge, tmp_path):
    good = [(100 + i, f"a clean text number {i} with more than ten words in it, all told; and line {i} ends", "en", "s0", 1) for i in range(30)]
    # Two documents each: a third copy would be the line dedup's.
    copies = [(200, good[3][1], "en", "s0", 1)] + [(None, good[4][1], "en", "s0", 1)] * 2
    secret = [(300, f"{good[5][1]} and then password=abcdefghijkl for all who read on to the very end of it", "en", "s0", 1)]
    for name, given in (("odd", [*edge, *good, *copies, *secret]), ("none", [])):
        docs = frame(given, clash=True)
        columns, schema = docs.columns, docs.dtypes
        for k, (_, stage) in enumerate(p.STAGES):
            out = f"{tmp_path}/{name}{k}"
            stage(spark, docs, "").write.parquet(out)
            docs = spark.read.parquet(out)
            if k < len(p.STAGES) - 1:
                assert docs.columns == columns and docs.dtypes == schema
        if not given:
            assert docs.count() == 0
            continue
        kept = {r.doc_id for r in docs.collect()}
        assert {100 + i for i in range(30)} <= kept and not kept & {1, 2, 3, 200, None}
        masked = spark.read.parquet(f"{tmp_path}/{name}3").filter("doc_id = 300").first()
        assert "[SECRET]" in masked.text and masked.n_chars == len(masked.text)
