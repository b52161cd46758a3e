import random
from collections import Counter

import numpy as np
import pytest

from posrecon.llm import jaccard as j


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(rows, k=4, num=85, den=100):
    """(doc_id, size, component) of every row by comparing all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and den * both >= num * len(sets[a] | sets[b]) and label[a] != label[b]:
                old = label[a]
                label = [label[b] if x == old else x for x in label]
    ids = {}
    for (i, _), x in zip(rows, label):
        if i is not None:
            ids[x] = min(i, ids.get(x, i))
    return Counter((i, len(s), i if not s else ids.get(x)) for (i, _), s, x in zip(rows, sets, label))


def result(df):
    return Counter(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()))


def mutated(rnd, words, share):
    return [w if rnd.random() > share else f"new{rnd.randint(0, 10**9)}" for w in words]


@pytest.fixture(scope="module")
def families():
    rnd = random.Random(5)
    rows = []
    for f in range(12):
        base = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([3, 5, 8, 9, 10, 30, 80, 200]))]
        for _ in range(rnd.choice([1, 2, 6, 25])):
            words = mutated(rnd, base, rnd.choice([0, 0.005, 0.01, 0.02, 0.03]))
            if rnd.random() < 0.3:
                words = words[rnd.randint(0, 2) :]
            rows.append((len(rows) * 3 + 1, " ".join(words)))
    rnd.shuffle(rows)
    return rows


def test_against_all_pairs(frame, families):
    assert result(j.joined(frame(families, clash=True))) == brute(families)


def test_other_threshold_and_small_groups(frame, families):
    rules = j.Join(words=5, num=80, den=100, group_tokens=300, group_sets=4, asking_sets=3, heavy_df=2, range_tokens=500)
    assert result(j.joined(frame(families), rules)) == brute(families, 5, 80, 100)


def test_hot_group_of_near_copies(frame):
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(mutated(rnd, base, rnd.choice([0.0, 0.02, 0.04, 0.06])))) for i in range(250)]
    rows += [(1000 + i, "passage " * 3 + " ".join(base[:20]) + f" tail{i} " * 20) for i in range(40)]
    small = j.Join(group_sets=20, asking_sets=15)
    assert result(j.joined(frame(rows), small)) == brute(rows)


def test_chain_across_groups(frame):
    """Each text links with its neighbours only, so one long chain is one component."""
    words = [f"c{k}" for k in range(400)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 60])) for i in range(100)]
    assert len({c for _, _, c in brute(rows)}) == 1
    assert result(j.joined(frame(rows), j.Join(group_sets=7))) == brute(rows)


def test_odd_rows(frame, edge):
    rows = [(r[0], r[1]) for r in edge] + [(8, "a text without an id, seven words"), (9, "x"), (10, "X\n"), (None, None)]
    assert result(j.joined(frame(rows, clash=True))) == brute(rows)
    assert j.joined(frame([])).count() == 0


def test_one_of_each(frame, edge, families):
    rows = [*((r[0], r[1]) for r in edge if r[0] != 4), (4, "One two three. Four five!\nSix"), *((i + 100, t) for i, t in families)]
    docs = frame(rows, clash=True)
    kept = j.one_of_each(docs)
    assert kept.columns == docs.columns
    want = Counter(i for i, _, c in brute(rows) if i is None or i == c)
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_one_of_each_with_repeated_ids(frame):
    copy, clean = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [
        (1, copy), (7, copy), (7, clean), (7, clean), (8, "a b c d e"), (8, "A b c d  e"), (None, copy), (None, "p q r s t"),
        (None, "p q r s t"), (None, ""), (None, None), (9, ""), (9, ""),
    ]
    got = Counter((r.doc_id, (r.text or "").lower().split().__repr__()) for r in j.one_of_each(frame(rows)).collect())
    want = [(1, copy), (7, clean), (8, "a b c d e"), (None, "p q r s t"), (None, ""), (None, ""), (9, "")]
    assert got == Counter((i, repr(t.split())) for i, t in want)


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1200)]
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    got = {r.id: r.component for r in j.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in label.items() if x in got}
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 500, rng.integers(1, 80)).astype(np.uint64)) for _ in range(30)]
    blobs = [s.tobytes() for s in sets]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (j._overlaps(blobs) == want).all() and (j._overlaps(blobs[:7], blobs[7:]) == want[:7, 7:]).all()


def test_many_rows_without_ids_and_with_one_id(frame):
    base = "one text that has rather more than five words in every single line of it and goes on for a while"
    near = lambda k: f"{base} number {k // 2} of the pairs which differ in the end by {k % 2} alone"
    rows = [(None, near(k)) for k in range(2000)] + [(7, near(k)) for k in range(2000, 4000)] + [(None, near(0))] * 500
    got = j.joined(frame(rows), j.Join(words=4, num=60, den=100)).collect()
    assert len(got) == len(rows) and all(r.component_id == 7 for r in got)
