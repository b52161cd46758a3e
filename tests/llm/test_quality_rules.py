import re
from collections import Counter

import pytest

from posrecon.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {p for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_counts_of_odd_texts(frame, edge):
    rows = [*edge, (8, "a b c d e a b c d e f"), (9, "x " * 9), (10, "# | <> &\n# | <> &\n \n \n\nend")]
    got = q.quality_report(frame(rows, clash=True)).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], *counts(r[1])) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_counts_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in q.quality_report(docs).collect():
        assert counts(texts[r.doc_id]) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)


def bucket(v):
    step = 1 << max(0, v.bit_length() - 6)
    return v - v % step


def test_sketches_merge_and_bound_the_error(frame):
    docs = frame([(i, "word " * (10 + i % 300), f"l{i % 2}", f"s{i % 5}") for i in range(400)])
    rows = q.measured(docs)
    whole = {tuple(r) for r in q.sketches(rows).collect()}
    halves = Counter()
    for k in (0, 1):
        for r in q.sketches(rows.filter(f"doc_id % 2 = {k}")).collect():
            halves[tuple(r)[:4]] += r.n
    assert {(*k, n) for k, n in halves.items()} == whole
    assert all(bucket(v) <= v <= bucket(v) * 33 / 32 for v in range(1, 5000))


def test_fences_follow_the_group_and_fall_back(frame):
    clean = "plain words of usual length make this sentence number "
    rows = [(i, clean + " ".join("abcdefghij"[(i + k) % 10] * 5 for k in range(9)), "en", "big") for i in range(300)]
    rows += [(1000 + i, clean.replace(" ", " ## ") + f"# {i}", "en", "marks") for i in range(200)]
    odd = (5000, clean.replace(" ", " ## ") + "#", "en", "big")
    few = (5001, clean.replace(" ", " ## ") + "#", "xx", "rare")
    kept = {r.doc_id: r.kept for r in q.quality_report(frame([*rows, odd, few])).collect()}
    assert all(kept[i] for i in range(300)) and all(kept[1000 + i] for i in range(200))
    assert not kept[5000]  # unusual for its source, though usual for the other
    assert kept[5001]  # a rare language is judged by all documents, where marks are usual enough


def test_keep_good_returns_its_input_columns(frame, edge):
    rows = [*edge, *((100 + i, f"a clean text number {i} with more than ten words in it, all told", "en", "s0") for i in range(30))]
    docs = frame(rows, clash=True)
    kept = q.keep_good(docs)
    assert kept.columns == docs.columns
    report = {r.doc_id: r.kept for r in q.quality_report(docs).collect()}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if report[r[0]])


def test_empty_table(frame):
    assert q.quality_report(frame([])).count() == 0 and q.keep_good(frame([])).count() == 0


@pytest.mark.parametrize("text", ["w " * 9, "a b c d e " * 5])
def test_base_check(frame, text):
    assert q.quality_report(frame([(1, text)])).first().base_failed
