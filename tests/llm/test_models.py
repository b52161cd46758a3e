"""Learned operators: small learnable tasks, gradients, and held-out labels."""

import zlib

import numpy as np
import pytest

from posrecon.llm import language as l, quality_model as g, toxicity as t

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels")}


def held(i, n, r):
    return zlib.crc32(str(i).encode()) % n == r


def test_language_held_out(tables):
    docs = tables["documents"]
    want = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = l.language_report(docs).collect()
    assert len(got) == len(want)
    assert all(r.held_out == held(r.doc_id, 3, 1) and 0 <= r.score <= 1 for r in got)
    out = [r.lang_pred == want[r.doc_id] for r in got if r.held_out]
    assert np.mean(out) > 0.98


def test_language_odd_rows(frame, edge):
    rows = [*edge, (70, "12 34 .. !?"), *((200 + i, "the cat and the dog " * 3, "en") for i in range(60)), *((300 + i, "der hund und die katze " * 3, "de") for i in range(60))]
    got = l.language_report(frame(rows, clash=True)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 70))
    assert by[200].lang_pred == "en" and by[300].lang_pred == "de" and by[5].lang_pred in ("en", "de", "fr")
    assert not by[None].held_out
    none = l.language_report(frame([(1, "words", None), (2, "more", None)])).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert l.language_report(frame([])).count() == 0


def test_language_gradient():
    net = l.ByteNet(length=12, embedding=3, widths=(2, 3), filters=4)
    rng = np.random.default_rng(0)
    p = {"E": rng.normal(size=(256, 3)), "U": rng.normal(size=(8, 3)), "c": rng.normal(size=3)}
    for w in net.widths:
        p |= {f"W{w}": rng.normal(size=(w, 3, 4)), f"b{w}": rng.normal(size=4)}
    x, y = rng.integers(0, 256, (5, 12)), np.array([0, 1, 2, 0, 1])
    loss = lambda: -np.log(l.Scorer(p, net).windows(x)[np.arange(5), y]).mean()
    grad = l._gradient(p, x, y, net)
    for k in p:
        at = np.unravel_index(np.abs(grad[k]).argmax(), p[k].shape)
        before = p[k][at]
        p[k][at] = before + 1e-6
        up = loss()
        p[k][at] = before - 1e-6
        assert (up - loss()) / 2e-6 == pytest.approx(grad[k][at], rel=1e-3)
        p[k][at] = before


def test_windows_cover_every_byte():
    net = l.ByteNet(length=16)
    for size in (0, 1, 13, 16, 17, 29, 100):
        seen = []
        scorer = l.Scorer.__new__(l.Scorer)
        scorer.net, scorer.p = net, {"c": np.zeros(2)}
        scorer.windows = lambda x: seen.append(x) or np.full((len(x), 2), 0.5)
        data = np.arange(1, size + 1, dtype=np.uint8)
        scorer.texts(data if size else np.zeros(1, np.uint8), np.array([0, size]))
        windows = np.concatenate(seen)
        runs = {tuple(w[i : i + 4]) for w in windows for i in range(13)}
        assert all(tuple(range(i, i + 4)) in runs for i in range(1, size - 2))


def test_quality_held_out(tables):
    want = {r.doc_id: r.quality for r in tables["labels"].collect()}
    got = g.quality_scores(tables["documents"], tables["labels"]).collect()
    assert all(r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    out = [(r.predicted, want[r.doc_id]) for r in got if r.held_out and r.doc_id in want]
    assert np.mean([a == b for a, b in out]) > 0.97
    assert np.mean([a for a, b in out if b == 1]) > 0.99


def test_quality_odd_rows(spark, frame, edge):
    docs = frame(edge, clash=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in g.quality_scores(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(1, None, 0), (4, 1, 0), (4, 1, 0), (999, 0, 0)], none.schema)
    got = g.quality_scores(docs, some).collect()
    assert len(got) == len(edge) and all(r.score > 0.5 for r in got)
    assert g.quality_scores(frame([]), some).count() == 0


def test_trees_learn_and_flat_arrays_agree_with_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    model = g.fit(x[:2000], y[:2000], g.Boosting(trees=30))
    scores = model.score(x[2000:])
    assert ((scores >= 0.5) == y[2000:]).mean() > 0.95
    for row, score in zip(x[2000:2050], scores):
        total = model.base
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    assert len(model.score(x[:0])) == 0


def test_toxicity_held_out(tables):
    want = {r.doc_id: r.toxic for r in tables["labels"].collect()}
    got = t.toxicity_report(tables["documents"], tables["labels"]).collect()
    out = [(r.toxic, want[r.doc_id]) for r in got if held(r.doc_id, 5, 0) and r.doc_id in want]
    assert np.mean([a for a, b in out if b == 1]) > 0.7
    assert np.mean([a for a, b in out if b == 0]) < 0.01
    assert all(0 <= r.severity <= 1 and r.toxic == (r.grade > 0) for r in got)


def test_three_grades_share_weights():
    rng = np.random.default_rng(0)
    bags, grades = [], []
    for _ in range(900):
        n = int(rng.integers(0, 7))
        bags.append([f"bad{k}" for k in rng.choice(8, n, replace=False)] + [f"w{k}" for k in rng.integers(0, 50, 10)])
        grades.append(float(n >= 2) + float(n >= 5))
    model = t.fit(bags[:600], grades[:600])
    assert model.grades == (0.0, 1.0, 2.0) and model.thresholds[0] < model.thresholds[1]
    severity = []
    for bag in bags[600:]:
        words = {f for w in bag for f in t._features(w, t.PRODUCTION)} & set(model.weights)
        chances = model.chances(sum(model.weights[w] for w in words))
        assert sum(chances) == pytest.approx(1)
        severity.append(sum(a * b for a, b in zip(model.grades, chances)))
    assert np.abs(np.array(severity) - grades[600:]).mean() < 0.25


def test_toxicity_odd_rows(spark, frame, edge):
    docs = frame(edge, clash=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = t.toxicity_report(docs, none).collect()
    assert len(got) == len(edge) and not any(r.toxic or r.severity for r in got)
    some = spark.createDataFrame([(4, 1, 0), (5, 1, 1), (5, 1, None)], none.schema)
    assert t.toxicity_report(docs, some).count() == len(edge)
    assert t.toxicity_report(frame([]), some).count() == 0


def test_samples_are_the_smallest_hashes(spark):
    from posrecon.llm.common import hash_place, smallest_hashes

    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    place = {r.doc_id: r.p for r in rows.select("doc_id", hash_place("doc_id").alias("p")).collect()}
    for most in (1, 40, 4999, 5000, 9000):
        got = {r.doc_id for r in smallest_hashes(rows, most, "doc_id").collect()}
        assert got == set(sorted(place, key=lambda k: (place[k], k))[:most])


def test_language_sample_is_bounded(frame):
    net = l.ByteNet(texts_per_language=7, max_languages=2, windows_per_text=1)
    rows = [(i, f"words of text {i} in some language", "abc"[i % 3 if i % 6 else 0]) for i in range(300)] + [(1, "the same row", "a")] * 50
    windows, labels = l.training_windows(frame(rows), net)
    assert sorted(set(labels)) == ["a", "b"] or sorted(set(labels)) == ["a", "c"]
    assert max(labels.count(x) for x in set(labels)) <= 7 and len(windows) == len(labels)


def test_severity_equals_single_documents(frame, edge):
    """Each text on its own: features, cumulative links, expected grade."""
    import math
    import re

    rules = t.PRODUCTION
    bags = [["vile", "hateful", f"w{i % 7}"] if i % 3 == 2 else ["rude", f"w{i % 5}"] if i % 3 else ["kind", f"w{i % 4}"] for i in range(90)]
    model = t.fit(bags, [float(i % 3) for i in range(90)], rules)
    assert list(model.grades) == [0.0, 1.0, 2.0] and model.thresholds[0] < model.thresholds[1]
    rows = [*edge, (20, "Vile, VILE hateful words"), (21, "rude w1 rudeness"), (22, "kind w0")]
    got = t.graded(frame(rows, clash=True), model, rules).collect()
    want = []
    for key, text, *_ in rows:
        words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
        features = {f for w in words for f in (w, *("<" + w[:n] for n in rules.prefixes if len(w) > n))}
        x = sum(model.weights.get(f, 0.0) for f in features)
        below = [0.0, *(1 / (1 + math.exp(x - cut)) for cut in model.thresholds), 1.0]
        chances = [below[k + 1] - below[k] for k in range(3)]
        want.append((key, sum(k * c for k, c in enumerate(chances)), max(range(3), key=lambda k: (chances[k], -k))))
    order = lambda r: (r[0] is None, r[0] or 0)
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order)):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-9) and a[2] == b[2]
    by = {r.doc_id: r.grade for r in got}
    assert (by[20], by[21], by[22]) == (2.0, 1.0, 0.0)


def test_forward_pass_equals_loops():
    net = l.ByteNet(length=10, embedding=3, widths=(2, 3), filters=4)
    rng = np.random.default_rng(4)
    p = {"E": rng.normal(size=(256, 3)), "U": rng.normal(size=(8, 3)), "c": rng.normal(size=3)}
    for w in net.widths:
        p |= {f"W{w}": rng.normal(size=(w, 3, 4)), f"b{w}": rng.normal(size=4)}

    def window(bytes_):
        x = [*bytes_, *[0] * (net.length - len(bytes_))]
        hidden = []
        for w in net.widths:
            for f in range(net.filters):
                sums = [sum(float(p["E"][x[i + k]] @ p[f"W{w}"][k][:, f]) for k in range(w)) for i in range(net.length - w + 1)]
                hidden.append(max(0.0, max(sums) + p[f"b{w}"][f]))
        z = np.array([sum(h * p["U"][k][c] for k, h in enumerate(hidden)) + p["c"][c] for c in range(3)])
        return np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    texts = [bytes(rng.integers(1, 256, n).tolist()) for n in (1, 5, 10, 11, 37)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = l.Scorer(p, net).texts(data, np.append(0, np.cumsum([len(x) for x in texts])))
    step = net.length - max(net.widths) + 1
    for text, probs in zip(texts, got):
        starts = range(0, max(1, len(text) - (net.length - step)), step)
        parts = [text[s : s + net.length] for s in starts]
        want = sum(window(x) * max(1, len(x)) for x in parts) / sum(max(1, len(x)) for x in parts)
        assert probs == pytest.approx(want, abs=1e-9)
