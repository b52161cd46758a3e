"""Mixing against a sequential model of the same draws."""

import re
import struct
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
import xxhash
from pyspark.sql import functions as F

from posrecon.llm import mixing as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def h64(*values):
    """Spark's xxhash64; (value, "i") is a 32-bit integer."""
    seed = 42
    for v in values:
        if v is None:
            continue
        raw = struct.pack("<i", v[0]) if isinstance(v, tuple) else v.encode() if isinstance(v, str) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def uniform(*values):
    return ((h64(*values) % (1 << 64)) >> 11) * 2.0**-53


def targets(sizes, mix):
    """Exact targets by source, resharing round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mix.weights[k % len(mix.weights)] for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(mix.most * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        unit = Fraction(left, share) if share else 0
        more = {s for s in names if s in full or mix.most * sizes[s] <= weight[s] * unit}
        if more == full:
            return {s: Fraction(mix.most * sizes[s]) if s in full else weight[s] * unit for s in names}, full, weight, left, share
        full = more


def near(p):
    return 0.0 if p <= m.EXACT else 1.0 if p >= 1 - m.EXACT else p


def pair(one, two, seed):
    (a, p), (b, q) = (one[2], one[5]), (two[2], two[5])
    to_one, to_two = min(a * (1 - p), b * q), min(a * p, b * (1 - q))
    if uniform((seed, "i"), one[0], two[0]) * (to_one + to_two) < to_two:
        p2 = 1.0 if a * (1 - p) <= b * q else near(p + to_one / a)
        q2 = 0.0 if b * q <= a * (1 - p) else near(q - to_one / b)
    else:
        p2 = 0.0 if a * p <= b * (1 - q) else near(p - to_two / a)
        q2 = 1.0 if b * (1 - q) <= a * p else near(q + to_two / b)
    return (*one[:5], p2), (*two[:5], q2)


def model(rows, mix=m.PRODUCTION):
    """(doc_id, source, size, copies, taken) of every row."""
    items = Counter((r[3], r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    sizes, n = defaultdict(int), Counter()
    for (s, _, size), count in items.items():
        sizes[s] += size * count
        n[s] += 1
    _, full, weight, left, share = targets(sizes, mix)
    out = []
    for s in sizes:
        rate = 0.0 if not sizes[s] else float(mix.most) if s in full else weight[s] * float(left) / float(share) / sizes[s]
        key, level, done = "1" if s is None else "0" + s, defaultdict(list), []
        nodes = -(-n[s] // mix.group)
        for (t, doc, size), count in items.items():
            if t == s:
                copies = count * rate
                base = int(copies + m.EXACT)
                e = (h64((mix.seed, "i"), key, doc, size), doc, size, count, base, 0.0 if not size else near(max(copies - base, 0.0)))
                (level[e[0] % nodes] if 0 < e[5] < 1 else done).append(e)
        largest, depth = -(-max(n.values()) // mix.group), 0
        while True:
            upper = defaultdict(list)
            for node, group in level.items():
                held = None
                for e in sorted(group, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2])):
                    if held is None:
                        held = e
                        continue
                    both = pair(held, e, mix.seed + depth)
                    held = next((x for x in both if 0 < x[5] < 1), None)
                    done += [x for x in both if x is not held]
                if held is not None:
                    upper[node // mix.group].append(held)
            if largest == 1:
                done += [e for g in upper.values() for e in g]
                break
            level, largest, depth = upper, -(-largest // mix.group), depth + 1
        for _, doc, size, count, base, p in done:
            whole = base + int(p) if size else 0
            cut = int(size * (p - int(p)) + 0.5)
            for k in range(count):
                mine = whole // count + (k < whole % count)
                out.append((doc, s, size, mine, size * mine + (cut if k == whole % count else 0)))
    return Counter(out)


def check(spark_rows, rows, mix):
    assert Counter((r.doc_id, r.source, r.size, r.copies, r.taken) for r in spark_rows) == model(rows, mix)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want, taken = targets(sizes, mix)[0], Counter()
    for r in spark_rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) <= 1e-9 * float(want[r.source])
        assert 0 <= r.taken <= mix.most * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.51 for s in sizes)
    assert sum(want.values()) == sum(sizes.values())


def text(k):
    return " ".join(f"w{i}" for i in range(1 + k * 7 % 61))


ROWS = [(i, text(i), "en", f"s{'abcdé'[i * i % 5]}") for i in range(700)]


def test_edge_rows_and_repeats(frame, edge):
    rows = [*edge, (20, "only one", "en", ""), *[(30, text(8), "en", "sa")] * 40, *[(None, text(5), "en", None)] * 9]
    check(m.mixed(frame(rows, clash=True)).collect(), rows, m.PRODUCTION)


@pytest.mark.parametrize("mix", [m.Mix(group=4, seed=1), m.Mix(weights=(5, 1), most=2, group=3, seed=2), m.Mix(weights=(1,), seed=3)])
def test_deep_trees_equal_the_model(frame, mix):
    check(m.mixed(frame(ROWS), mix=mix).collect(), ROWS, mix)


def test_small_sources_are_full(frame):
    rows = [*ROWS[:400], (9000, "a b c", "en", "s0"), (9001, "a b", "en", "zz"), (9002, None, "en", "empty")]
    got = m.mixed(frame(rows)).collect()
    check(got, rows, m.PRODUCTION)
    by_id = {r.doc_id: r for r in got}
    assert (by_id[9000].taken, by_id[9001].taken, by_id[9002].taken) == (9, 6, 0)


def test_many_rows_of_one_document(spark):
    df = spark.range(20_000).select(
        F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source")
    ).unionByName(spark.createDataFrame([(8, "x " * 20_000, "t")], "doc_id long, text string, source string"))
    got = m.mixed(df).groupBy("source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("taken").alias("top"))
    assert {tuple(r) for r in got.collect()} == {("s", 20_000, 26_667, 3), ("t", 1, 53_333, 53_333)}


def test_same_result_for_any_partitioning(frame):
    whole = frame(ROWS)
    one, two = (Counter(map(tuple, m.mix_report(df).collect())) for df in (whole, whole.repartition(17, "n_chars", "doc_id")))
    assert one == two


def test_draws_keep_expectations():
    """Over many seeds a document is taken as often as its source's rate says."""
    rows = [(i, text(i), "en", "ab"[i % 2]) for i in range(60)]
    copies, n = Counter(), 300
    for seed in range(n):
        for (doc, _, size, mine, _), k in model(rows, m.Mix(seed=seed, group=8)).items():
            copies[doc] += mine * k
    sizes = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in "ab"}
    want = targets(sizes, m.PRODUCTION)[0]
    for r in rows:
        assert abs(copies[r[0]] / n - float(want[r[3]] / sizes[r[3]])) < 0.15


def test_empty_table(frame):
    assert m.mix_report(frame([])).count() == 0
