"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics (counts and rates of the whole text) are built-in expressions. Trees grow
level by level on the driver, on a bounded sample of labelled documents: statistics are put
into bins, and the split of a node is the best by gain over the sums of gradients and
second derivatives per bin. A model is three flat arrays (feature, threshold, leaf value) of complete
binary trees, and numpy walks whole batches through them at once.

Texts of any length are measured whole. A null or empty text has statistics of zero and is scored like any other. Several labels of
one document count as their mean; null labels, and labels of unknown documents, are not
used. Without labels the score is 0.5, with one kind of label it is that label's share.
Repeated rows are scored alike; an empty table gives an empty result; other columns than
the id and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from posrecon.llm.common import let, saved, smallest_hashes, words_of
from posrecon.llm.language import fold
from posrecon.llm.quality_rules import measured

FEATURES = (
    "n_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "capital_rate", "exclaim_rate",
    "distinct_rate", "same_next_rate", "line_words", "digit_rate", "stop_rate",
)


@dataclass(frozen=True)
class Boosting:
    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    ridge: float = 1.0
    least_weight: float = 2.0
    #: Labelled documents that training may use.
    max_rows: int = 20_000


PRODUCTION = Boosting()


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, features) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ratio = lambda a, b: 1000.0 * a / F.greatest(b, F.lit(1))
    words = let(
        words_of(F.col("text")),
        lambda ws: F.struct(
            ratio(F.size(F.array_distinct(ws)), F.size(ws)).alias("distinct_rate"),
            ratio(F.size(F.filter(ws, lambda w, i: w == F.get(ws, i + 1))), F.size(ws)).alias("same_next_rate"),
        ),
    )
    count = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    rows = measured(docs.select("doc_id", "text")).withColumn("w_", words)
    n = F.col("m_.n_words")
    more = {
        "distinct_rate": F.col("w_.distinct_rate"), "same_next_rate": F.col("w_.same_next_rate"),
        "line_words": 1.0 * n / (count("\n+") + 1), "digit_rate": ratio(count("[0-9]+"), F.col("m_.word_chars")),
        "stop_rate": ratio(count("[.]+"), n),
    }
    values = F.array(*((more[f] if f in more else F.col(f"m_.{f}")).cast("double") for f in FEATURES))
    return rows.select("doc_id", values.alias("features"))


@dataclass(frozen=True)
class Trees:
    """Complete trees as rows of flat arrays; node i has children 2i+1 and 2i+2."""

    base: float
    feature: object
    threshold: object
    leaf: object

    def score(self, x):
        """Probabilities of rows of statistics."""
        import numpy as np

        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x, y, b: Boosting = PRODUCTION) -> Trees:
    import numpy as np

    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    inner, leaves = (1 << b.depth) - 1, 1 << b.depth
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, b.bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), base)
    feature, threshold, leaf = [], [], []
    for _ in range(b.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        feats, limits = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(b.depth):
            first, width = (1 << level) - 1, 1 << level
            best = np.zeros(width)
            where = node - first
            whole = [np.bincount(where, v, width) for v in (g, h)]
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                k = len(c) + 1
                cell = where * k + binned[:, f]
                gl, hl = (np.bincount(cell, v, width * k).reshape(width, k).cumsum(axis=1)[:, :-1] for v in (g, h))
                gr, hr = whole[0][:, None] - gl, whole[1][:, None] - hl
                gain = gl**2 / (hl + b.ridge) + gr**2 / (hr + b.ridge) - (whole[0] ** 2 / (whole[1] + b.ridge))[:, None]
                gain[(hl < b.least_weight) | (hr < b.least_weight)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best + 1e-9
                best = np.where(better, top, best)
                feats[first : first + width] = np.where(better, f, feats[first : first + width])
                limits[first : first + width] = np.where(better, c[at], limits[first : first + width])
            node = 2 * node + 1 + (x[np.arange(len(y)), feats[node]] > limits[node])
        where = node - inner
        value = -b.rate * np.bincount(where, g, leaves) / (np.bincount(where, h, leaves) + b.ridge)
        margin += value[where]
        feature.append(feats)
        threshold.append(limits)
        leaf.append(value)
    return Trees(base, np.array(feature), np.array(threshold), np.array(leaf))


def labelled(labels: DataFrame, column: str, max_rows: int, keep: Column) -> DataFrame:
    """(doc_id, y): the mean label per document, of the ``max_rows`` with the smallest hashes."""
    rows = labels.filter(keep & F.col(column).isNotNull()).groupBy("doc_id").agg(F.avg(column).alias("y"))
    return smallest_hashes(rows, max_rows, "doc_id")


def scored(docs: DataFrame, labels: DataFrame, keep: Column, column: str = "quality", b: Boosting = PRODUCTION) -> DataFrame:
    """(doc_id, score) of every row of ``docs``; labels are learned where ``keep`` holds."""
    import numpy as np

    rows = saved(statistics(docs))
    known = labelled(labels, column, b.max_rows, keep).join(rows, "doc_id")
    # Rows that repeat an id count once, so that no more rows than the sample has are collected.
    known = known.groupBy("doc_id").agg(F.min("features").alias("features"), F.min("y").alias("y")).collect()
    x = np.array([r["features"] for r in known]).reshape(len(known), len(FEATURES))
    order = np.lexsort(x.T) if len(known) else []
    model = fit(x[order], np.array([r["y"] for r in known])[order], b)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            scores = pa.array(model.score(values), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and class of every row; documents with remainder 0 modulo 5 are held out."""
    found = scored(docs, labels, fold(5) != 0)
    return found.select(
        "doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )
