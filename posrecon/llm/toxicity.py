"""Toxicity: ordinal regression with cumulative links over the words of a text.

``P(grade <= k) = logistic(theta_k - w.x)``: one weight per word serves all thresholds,
which are kept in order as a first value and positive steps. ``x`` holds a 1 for each
distinct feature of the text: its words (runs of letters, lower case) and the beginnings
of its words, which catch words that share a stem. Features are those that the training
sample has in ``min_docs`` documents or more and that tell its grades apart best. The severity is the expected grade; a document also gets its most
likely grade (the lowest of equals). Training is numpy on the driver, on the
words of a bounded sample of labelled documents; scoring is one pass over all texts.

Texts of any length are scored whole; a task keeps the distinct words of one text. A null or empty text has no words. Several labels of one document count as the highest; null
labels are not used. Without labels every severity is the lowest grade (0). Repeated rows
are scored alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from posrecon.llm.common import smallest_hashes
from posrecon.llm.language import fold
from posrecon.llm.tokens import WordCache, batches_of

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class OrdinalRules:
    min_docs: int = 4
    prefixes: tuple[int, ...] = (4, 5)
    max_features: int = 4000
    #: Labelled documents that training may use.
    max_rows: int = 10_000
    steps: int = 300
    rate: float = 0.1
    ridge: float = 2e-5


PRODUCTION = OrdinalRules()


@dataclass(frozen=True)
class Ordinal:
    grades: tuple[float, ...]
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def chances(self, total: float) -> list[float]:
        """Probability of each grade for a sum of weights."""
        import math

        below = [1 / (1 + math.exp(max(-700.0, min(700.0, total - t)))) for t in self.thresholds]
        return [b - a for a, b in zip([0.0, *below], [*below, 1.0])]


def _words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _features(word: str, rules: OrdinalRules) -> tuple[str, ...]:
    return (word, *("<" + word[:n] for n in rules.prefixes if len(word) > n))


def _select(bags: list[list[str]], level, kinds: int, rules: OrdinalRules):
    """Names of the features in use, and (document, feature) cells as two arrays."""
    import numpy as np

    ids: dict[str, int] = {}
    of_word: dict[str, tuple[int, ...]] = {}
    cells = [array("i") for _ in bags]
    for bag, held in zip(bags, cells):
        for word in bag:
            if word not in of_word:
                of_word[word] = tuple(ids.setdefault(f, len(ids)) for f in _features(word, rules))
            held.extend(of_word[word])
    pairs = [np.unique(np.frombuffer(c, np.int32)) if len(c) else np.zeros(0, np.int32) for c in cells]
    doc = np.repeat(np.arange(len(bags)), [len(x) for x in pairs])
    feature = np.concatenate(pairs) if pairs else np.zeros(0, np.int32)
    seen = np.bincount(feature, minlength=len(ids))
    n, best = len(bags), np.zeros(len(ids))
    for j in range(1, kinds):
        above = level >= j
        n1 = above.sum()
        both = np.bincount(feature, above[doc], len(ids))
        share = seen / n
        spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / (n - n1)))
        best = np.maximum(best, np.abs(both / n1 - (seen - both) / (n - n1)) / spread)
    best[seen < rules.min_docs] = 0
    top = np.argsort(-best, kind="stable")[: rules.max_features]
    top = top[best[top] > 0]
    place = np.full(len(ids), -1)
    place[top] = np.arange(len(top))
    names = list(ids)
    used = place[feature] >= 0
    return [names[i] for i in top], doc[used], place[feature[used]]


def fit(bags: list[list[str]], grades: list[float], rules: OrdinalRules = PRODUCTION) -> Ordinal:
    """Adam on the likelihood of the grades, with a ridge on the feature weights."""
    import numpy as np

    kinds = sorted(set(grades))
    if len(kinds) < 2:
        return Ordinal(tuple(kinds) or (0.0,), {}, ())
    level = np.array([kinds.index(g) for g in grades])
    vocab, doc, word = _select(bags, level, len(kinds), rules)
    n, k = len(bags), len(kinds) - 1
    upto = np.array([(level <= j).mean() for j in range(k)])
    start = np.log(upto / (1 - upto))
    #: Weights, first threshold, logs of the steps between thresholds.
    theta = np.concatenate([np.zeros(len(vocab)), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    rows = np.arange(n)
    for step in range(1, rules.steps + 1):
        w, first, gaps = theta[: len(vocab)], theta[len(vocab)], np.exp(theta[len(vocab) + 1 :])
        cut = first + np.concatenate([[0.0], np.cumsum(gaps)])
        total = np.bincount(doc, w[word], n)
        below = np.concatenate([np.zeros((n, 1)), logistic(cut[None] - total[:, None]), np.ones((n, 1))], axis=1)
        chance = np.maximum(below[rows, level + 1] - below[rows, level], 1e-12)
        slope = below * (1 - below)
        up, low = slope[rows, level + 1] / chance, slope[rows, level] / chance
        d_total = (up - low) / n
        d_cut = np.zeros(k + 2)
        np.add.at(d_cut, level + 1, -up / n)
        np.add.at(d_cut, level, low / n)
        d_cut = d_cut[1:-1]
        d_gaps = np.cumsum(d_cut[::-1])[::-1][1:] * gaps
        grad = np.concatenate([np.bincount(word, d_total[doc], len(vocab)) + rules.ridge * w, [d_cut.sum()], d_gaps])
        m += 0.1 * (grad - m)
        v += 0.001 * (grad**2 - v)
        theta -= rules.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(theta[len(vocab) + 1 :])
    cut = theta[len(vocab)] + np.concatenate([[0.0], np.cumsum(gaps)])
    weights = {w: float(theta[i]) for i, w in enumerate(vocab)}
    return Ordinal(tuple(kinds), weights, tuple(map(float, cut)))


def training_words(docs: DataFrame, labels: DataFrame, keep: Column, column: str, rules: OrdinalRules) -> tuple[list, list]:
    """Distinct words and grade of a bounded sample of labelled documents."""
    known = labels.filter(keep & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).cast("double").alias("grade"))
    known = smallest_hashes(known, rules.max_rows, "doc_id")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            bags = pa.array([" ".join(sorted(_words(t.as_py()))) for t in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), bags, batch.column(2)], ["doc_id", "words", "grade"])

    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).join(
        known.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id"
    )
    # Rows that repeat an id count once, so that no more rows than the sample has are collected.
    once = joined.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("grade").alias("grade"))
    rows = once.mapInArrow(run, "doc_id long, words string, grade double").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["words"]))
    one: dict[str, str] = {}  # each word is held once, however many texts have it
    return [[one.setdefault(w, w) for w in r["words"].split()] for r in rows], [r["grade"] for r in rows]


def graded(docs: DataFrame, model: Ordinal, rules: OrdinalRules = PRODUCTION) -> DataFrame:
    """(doc_id, severity, grade) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        # The features of a chunk between blanks, as far as the model knows them.
        known = WordCache(
            lambda chunk: tuple(f for w in _WORD.findall(chunk) for f in _features(w, rules) if f in m.weights), 300_000
        )
        schema = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("grade", pa.float64())])

        def rows():
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    chunks = set((text.as_py() or "").lower().split())
                    words = {w for ws in map(known.__getitem__, chunks) for w in ws}
                    chances = m.chances(sum(m.weights[w] for w in sorted(words)))
                    severity = sum(g * c for g, c in zip(m.grades, chances))
                    yield key, severity, m.grades[max(range(len(chances)), key=chances.__getitem__)]

        yield from batches_of(rows(), schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, severity double, grade double")


def toxicity_report(docs: DataFrame, labels: DataFrame, rules: OrdinalRules = PRODUCTION) -> DataFrame:
    """Expected severity of every row; grades are ``labels.toxic``.

    Documents with remainder 0 modulo 5 are held out of training.
    """
    model = fit(*training_words(docs, labels, fold(5) != 0, "toxic", rules), rules)
    return graded(docs, model, rules).select(
        "doc_id", "severity", F.col("grade").cast("int").alias("grade"), (F.col("grade") > model.grades[0]).alias("toxic")
    )
