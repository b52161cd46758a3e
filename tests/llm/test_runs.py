"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from posrecon.llm import runs as r

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, min_words=6, min_repeats=4):
    """Stretches by period, kept where no smaller period fits."""
    n, found = len(words), {}
    for q in range(1, n // min_repeats + 1):
        i = 0
        while i < n - q:
            k = i
            while k < n - q and words[k] == words[k + q]:
                k += 1
            length = k - i + q
            if k > i and length >= max(min_words, min_repeats * q):
                found.setdefault((i, length), q)
            i = k + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_lyndon(s):
    """Longest Lyndon word at each position by next smaller suffixes, 0 ending each part."""
    out = []
    for i, x in enumerate(s):
        j = i + 1
        while x and j < len(s) and s[j:] > s[i:]:
            j += 1
        out.append(j - i if x else 0)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_lyndon_arrays(seed):
    rnd = random.Random(seed)
    k = rnd.choice([1, 2, 3, 10])
    s = [0, *(rnd.choice([0, *range(1, k + 1), *range(1, k + 1)]) for _ in range(rnd.randint(1, 120))), 0]
    # The marks are ordered like their suffixes here; roots never reach over one.
    assert r.lyndon_array(s, k).tolist() == brute_lyndon(s)


@pytest.mark.parametrize("seed", range(80))
def test_runs_equal_brute_force(seed):
    rnd = random.Random(seed)

    def text():
        out = []
        while len(out) < rnd.randint(0, 150):
            if rnd.random() < 0.5:
                part = [rnd.randint(0, rnd.choice([1, 3, 50])) for _ in range(rnd.randint(1, 9))]
                out += (part * 9)[: rnd.randint(1, 9 * len(part))]
            else:
                out.append(rnd.randint(0, 4))
        return out

    texts = [text() for _ in range(rnd.randint(0, 12))]
    rules = r.Rules(rnd.choice([6, 9]), rnd.choice([4, 5]))
    assert [sorted(x) for x in r.find_runs(texts, rules)] == [brute_runs(t, rules.min_words, rules.min_repeats) for t in texts]


def test_one_word_and_fibonacci():
    fib = ["a", "ab"]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    texts = [[7] * 50_000, [ord(c) for c in fib[-1]], [1, 2] * 20_000 + [1, 1]]
    found = r.find_runs(texts)
    assert found[0] == [(0, 50_000, 1)] and found[1] == [] and found[2] == [(0, 40_001, 2)]


def planted(doc_id, words):
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def want(doc_id, text):
    words = planted(doc_id, WORD.findall(text or ""))
    runs = brute_runs(words)
    dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (
        doc_id, len(runs), *top, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)),
        sha(" ".join(w for k, w in enumerate(words) if k not in dropped)),
    )


def test_report_of_odd_texts(frame, edge):
    rows = [x if x[0] != 5 else (5, " ".join(x[1].split()[:400])) for x in edge]
    rows += [(10 + i, f"start {i} " + "go on and " * (i % 9) + "la " * (i % 11) + "end end \x85") for i in range(120)]
    got = r.run_report(frame(rows, clash=True))
    assert Counter(tuple(x) for x in got.collect()) == Counter(want(x[0], x[1]) for x in rows)


def test_report_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [x for x in docs.select("doc_id", "text").collect() if len(x.text or "") < 6000]
    got = {x.doc_id: tuple(x) for x in r.run_report(docs).collect()}
    assert len(got) == docs.count()
    assert all(got[x.doc_id] == want(x.doc_id, x.text) for x in texts)
    assert sum(x[1] > 0 for x in got.values()) > 5


def test_long_text_in_linear_time(frame):
    rnd = random.Random(1)
    text = " ".join(rnd.choice("ab") for _ in range(300_000)) + " x" * 100_000
    row = r.periodic_runs(frame([(1, text)])).first()
    assert row.n_words == 400_000 and (300_000, 100_000, 1) in {tuple(x) for x in row.runs}
    assert row.collapsed.count("x") == 1


def test_empty_table_and_rules(frame):
    assert r.run_report(frame([])).count() == 0
    assert r.periodic_runs(frame([(1, None)])).first().runs == []
    with pytest.raises(ValueError):
        r.Rules(min_words=5)
    assert np.array_equal(r.lyndon_array([0, 0], 0), [0, 0])
