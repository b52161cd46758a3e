import hashlib
from collections import Counter, defaultdict

import numpy as np

from posrecon.llm import line_dedup as d

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cleaned(rows):
    """(doc_id, lines, dropped, text) of every row, one line at a time."""
    low = lambda i: -(1 << 63) if i is None else i
    key = lambda line: line.strip(SPACES).translate(LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(low(i))
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(holders.get(key(x), ())) < 3 or low(i) == max(holders[key(x)])]
        yield i, len(lines), len(lines) - len(stay), "\n".join(stay)


LINE = "This Line Is Repeated Often"
ROWS = [
    (11, f"{LINE}\nown text of eleven\n  {LINE.lower()}\t"), (12, f"\x0b{LINE.upper()}\n\nother"), (13, LINE), (14, f"end\n{LINE} \n{LINE}"),
    (15, "Ünïcode Line With ÄÖÜ ßß"), (16, "ünïcode line with äöü ßß\nÜnïcode Line With ÄÖÜ ßß"), (17, "ünïcode line with ÄÖÜ ßß"),
    (18, "exactly nineteen ch\nexactly twenty chara"), (19, "exactly nineteen ch\nexactly twenty chara"), (20, "exactly nineteen ch\nexactly twenty chara"),
    (14, f"end\n{LINE} \n{LINE}"), (14, "another text of the same id\nexactly twenty chara"),
]


def test_against_single_lines(frame, edge):
    rows = [*((r[0], r[1]) for r in edge), *ROWS]
    got = d.line_report(frame(rows, clash=True)).collect()
    want = Counter((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in cleaned(rows))
    assert Counter(map(tuple, got)) == want


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = Counter((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in cleaned([tuple(r) for r in docs.collect()]))
    assert Counter(map(tuple, d.line_report(docs).collect())) == want


def test_split_hot_shards(frame):
    rows = [(i, f"{LINE}\nline number {i} of its own kind") for i in range(300)]
    rules = d.LineRules(min_shards=4, group_lines=16)
    got = d.without_repeated_lines(frame(rows), rules).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(i, t) for i, _, _, t in cleaned(rows)]


def test_columns_and_empty_table(frame, edge):
    docs = frame(edge, clash=True)
    out = d.without_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() == len(edge)
    assert out.filter("text is null").count() == 1
    assert d.line_report(frame([])).count() == 0


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_deletion_is_undone_by_insertion(frame):
    docs = frame(ROWS)
    some = docs.filter("doc_id in (13, 14, 20)")
    whole = d.build(d.lines_of(docs))
    less = d.delete(whole, some)
    again = d.insert(less, some)
    assert rows_of(less.counts) == rows_of(d.build(d.lines_of(docs.filter("doc_id not in (13, 14, 20)"))).counts)
    assert rows_of(again.counts) == rows_of(whole.counts) and rows_of(again.refs) == rows_of(whole.refs)
    assert rows_of(d.insert(whole, some).counts) == rows_of(whole.counts)
    assert rows_of(d.delete(less, some).counts) == rows_of(less.counts)
    for state in (whole, less, again):
        filters = {r.shard: d.CuckooFilter.load(r.data) for r in state.filters.collect()}
        frequent = [r.k1 for r in state.counts.filter("n_docs >= 3").collect()]
        assert all(filters[k % state.shards].contains(np.array([k]))[0] for k in frequent)
    gone = {r.k1 for r in whole.counts.filter("n_docs >= 3").collect()} - {r.k1 for r in less.counts.filter("n_docs >= 3").collect()}
    filters = {r.shard: d.CuckooFilter.load(r.data) for r in less.filters.collect()}
    assert gone and not any(filters[k % less.shards].contains(np.array([k]))[0] for k in gone)
    lines = d.lines_of(docs.filter("doc_id not in (13, 14, 20)"))
    assert rows_of(d.dropped_lines(less, lines).select("id")) == rows_of(d.dropped_lines(d.build(lines), lines).select("id"))


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = rng.integers(-(2**63), 2**63 - 1, 12_000)
    held, other = keys[:2000], keys[2000:]
    for capacity in (2000, 16):  # the second needs further layers
        f = d.CuckooFilter(capacity=capacity)
        f.insert(held)
        assert f.contains(held).all() and f.contains(other).mean() < 0.01
        f.delete(held[:500])
        assert f.contains(held[500:]).all() and f.contains(held[:500]).mean() < 0.01
        assert (d.CuckooFilter.load(f.dump()).contains(keys) == f.contains(keys)).all()
    same = d.CuckooFilter(capacity=16)
    same.insert(np.full(40, 7))
    same.delete(np.full(39, 7))
    assert same.contains(np.array([7]))[0]


def test_deletion_keeps_keys_of_equal_fingerprints():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 6000)
    f = d.CuckooFilter(capacity=16)
    prints, first, _ = f._spots(keys)
    seen, pairs = {}, []
    for i, spot in enumerate(zip(prints.tolist(), first.tolist())):
        if spot in seen:
            pairs.append((keys[seen[spot]], keys[i]))
        seen[spot] = i
    assert len(pairs) > 5
    for g, h in pairs:
        others = keys[:200][~np.isin(keys[:200], [g, h])]
        for order in ([g], others, [h]), ([h], others, [g]), (others, [g], [h]):
            f = d.CuckooFilter(capacity=16)
            for some in order:
                f.insert(np.array(some))
            assert f.contains(np.array([g, h])).all() and len(f.spare)
            f.delete(np.array([h]))
            assert f.contains(np.array([g]))[0] and f.contains(others).all()
            f.delete(np.array([g]))
            assert not f.contains(np.array([g, h])).any() and f.contains(others).all()


def test_keys_of_one_shard_fill_one_table():
    import time

    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(-(2**57), 2**57 - 1, 50_100))[:50_000] * 64 + 5
    start = time.monotonic()
    f = d.CuckooFilter(capacity=len(keys))
    f.insert(keys)
    assert f.contains(keys).all() and len(f.spare) == 0
    f.delete(keys[::2])
    assert f.contains(keys[1::2]).all() and f.contains(keys[::2]).mean() < 0.01
    f.insert(keys[::2])
    assert f.contains(keys).all() and len(f.spare) == 0 and time.monotonic() - start < 20


def test_outgrown_filters_are_built_anew(frame, monkeypatch):
    monkeypatch.setattr(d, "SPARE", 3)
    text = lambda i: "\n".join(f"a line of its own kind, number {i + k}" for k in range(60))
    docs = frame([(10 * i + j, text(100 * i)) for i in range(12) for j in range(3)])
    rules = d.LineRules(min_shards=1)
    state = d.build(d.lines_of(docs.filter("doc_id < 20"), rules), rules)
    for low, high in ((20, 60), (60, 100), (100, 120)):
        state = d.insert(state, docs.filter(f"doc_id >= {low} and doc_id < {high}"), rules)
    state = d.delete(state, docs.filter("doc_id % 10 = 0 and doc_id < 40"), rules)
    (row,) = state.filters.collect()
    f = d.CuckooFilter.load(row.data)
    frequent = np.array([r.k1 for r in state.counts.filter("n_docs >= 3").collect()])
    assert len(frequent) == 480 and f.contains(frequent).all() and len(f.table) >= 128
