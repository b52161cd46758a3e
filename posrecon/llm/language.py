"""Language identification with a convolutional network over bytes.

A text's UTF-8 bytes are cut into windows of fixed length (the last is padded with zero
bytes; neighbours overlap so that no run of bytes is lost). Byte embeddings go through
filters of several widths, each filter keeps its largest response in the window, and a
softmax over these gives the languages. The text's probabilities are those of its windows
weighted by their bytes. Training is numpy on the driver, on windows of a bounded sample
per language; windows of all texts are scored in batches, with embedding and filters
multiplied out to one table per position.

A null text, or one without any letter, is ``und`` with score 0, and so is everything if
there is nothing to learn from. Of languages with equal probability the first by name is taken.
Rows with a null language or a null id are not learned from (a null id is not held out).
Texts of any length are read whole; repeated rows are scored alike; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from posrecon.llm.common import hash_place
from posrecon.llm.tokens import batches_of

UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class ByteNet:
    length: int = 256
    embedding: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    #: Texts per language and windows per text that training may use.
    texts_per_language: int = 1500
    #: Languages that are learned, those with most texts first.
    max_languages: int = 1000
    windows_per_text: int = 3
    epochs: int = 4
    batch: int = 64
    rate: float = 0.01
    seed: int = 7
    #: Windows scored at a time.
    chunk: int = 256


PRODUCTION = ByteNet()


def _windows(data, starts, ends, net: ByteNet):
    import numpy as np

    at = starts[:, None] + np.arange(net.length)
    inside = at < ends[:, None]
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0)


def train(windows: list[bytes], labels, n_classes: int, net: ByteNet = PRODUCTION) -> dict:
    """Weights after ``epochs`` of Adam on cross entropy."""
    import numpy as np

    rng = np.random.default_rng(net.seed)
    x = np.zeros((len(windows), net.length), np.uint8)
    for row, w in zip(x, windows):
        row[: len(w)] = np.frombuffer(w, np.uint8)[: net.length]
    y = np.asarray(labels)
    p = {"E": rng.normal(0, 0.5, (256, net.embedding)), "c": np.zeros(n_classes)}
    p["U"] = rng.normal(0, 0.1, (len(net.widths) * net.filters, n_classes))
    for w in net.widths:
        p[f"W{w}"] = rng.normal(0, (w * net.embedding) ** -0.5, (w, net.embedding, net.filters))
        p[f"b{w}"] = np.zeros(net.filters)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(net.epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), net.batch):
            pick = order[i : i + net.batch]
            grad = _gradient(p, x[pick], y[pick], net)
            step += 1
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                p[k] -= net.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return p


def _gradient(p: dict, x, y, net: ByteNet) -> dict:
    import numpy as np

    n = len(x)
    rows = np.arange(n)[:, None]
    embedded = p["E"][x]
    best, peak = {}, []
    for w in net.widths:
        t = net.length - w + 1
        out = sum(embedded[:, k : k + t] @ p[f"W{w}"][k] for k in range(w)) + p[f"b{w}"]
        best[w] = out.argmax(axis=1)
        peak.append(np.take_along_axis(out, best[w][:, None], 1)[:, 0])
    h = np.maximum(np.concatenate(peak, axis=1), 0)
    d = _softmax(h @ p["U"] + p["c"])
    d[np.arange(n), y] -= 1
    d /= n
    grad = {"U": h.T @ d, "c": d.sum(axis=0), "E": np.zeros_like(p["E"])}
    back = (d @ p["U"].T) * (h > 0)
    for j, w in enumerate(net.widths):
        part = back[:, j * net.filters : (j + 1) * net.filters]
        grad[f"b{w}"] = part.sum(axis=0)
        grad[f"W{w}"] = np.zeros_like(p[f"W{w}"])
        for k in range(w):
            seen = x[rows, best[w] + k]
            grad[f"W{w}"][k] = np.einsum("bf,bfe->ef", part, p["E"][seen])
            np.add.at(grad["E"], seen, part[:, :, None] * p[f"W{w}"][k].T[None])
    return grad


def _softmax(z):
    import numpy as np

    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Scorer:
    """Probabilities of texts from trained weights."""

    def __init__(self, weights: dict, net: ByteNet = PRODUCTION):
        import numpy as np

        self.net, self.p = net, weights
        self.tables = {w: [np.ascontiguousarray(weights["E"] @ weights[f"W{w}"][k]) for k in range(w)] for w in net.widths}

    def windows(self, x):
        """Probabilities of windows (rows of bytes)."""
        import numpy as np

        peak = []
        for w in self.net.widths:
            t = self.net.length - w + 1
            out = self.tables[w][0][x[:, :t]]
            for k in range(1, w):
                out += self.tables[w][k][x[:, k : k + t]]
            peak.append(out.max(axis=1) + self.p[f"b{w}"])
        return _softmax(np.maximum(np.concatenate(peak, axis=1), 0) @ self.p["U"] + self.p["c"])

    def texts(self, data, offsets):
        """Probabilities of texts that lie in ``data`` between successive offsets."""
        import numpy as np

        net = self.net
        step = net.length - max(net.widths) + 1
        sizes = np.diff(offsets)
        many = np.maximum(1, -(-(sizes - (net.length - step)) // step))
        owner = np.repeat(np.arange(len(sizes)), many)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        starts, ends = offsets[:-1][owner] + nth * step, offsets[1:][owner]
        total = np.zeros((len(sizes), len(self.p["c"])))
        for i in range(0, len(owner), net.chunk):
            cut = slice(i, i + net.chunk)
            probs = self.windows(_windows(data, starts[cut], ends[cut], net))
            weight = np.minimum(net.length, np.maximum(1, ends[cut] - starts[cut]))
            np.add.at(total, owner[cut], probs * weight[:, None])
        return total / total.sum(axis=1, keepdims=True)


def fold(n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % n


def training_windows(docs: DataFrame, net: ByteNet = PRODUCTION) -> tuple[list[bytes], list[str]]:
    """A bounded sample of windows with their languages, the same for the same rows."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(net.max_languages)
    # Per language the smallest hashes: a first cut at twice the share that is wanted leaves few rows to rank.
    cut = F.least(F.lit(1.0), F.lit(2.0 * (net.texts_per_language + 50)) / F.col("n")) * float(1 << 63)
    order = hash_place("doc_id", "text")
    chosen = counts.select("lang", cut.alias("cut"))
    few = rows.join(F.broadcast(chosen), "lang").withColumn("order", order).where(F.col("order") <= F.col("cut"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    start = lambda j: F.floor(F.greatest(F.length("text") - net.length, F.lit(0)) * (j / max(1, net.windows_per_text - 1))) + 1
    pieces = F.array(
        *(F.encode(F.substr(F.col("text"), start(j).cast("int"), F.lit(net.length)), "utf-8") for j in range(net.windows_per_text))
    )
    sample = few.select("lang", "order", pieces.alias("pieces")).withColumn("place", place)
    windows, labels = [], []
    for r in sorted(sample.where(F.col("place") <= net.texts_per_language).collect(), key=lambda r: (r["order"], r["pieces"])):
        pieces = list(dict.fromkeys(bytes(x)[: net.length] for x in r["pieces"]))
        windows += pieces
        labels += [r["lang"]] * len(pieces)
    return windows, labels


def predicted(docs: DataFrame, learn_from: DataFrame, net: ByteNet = PRODUCTION) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``."""
    windows, labels = training_windows(learn_from, net)
    names = sorted(set(labels))
    index = {n: k for k, n in enumerate(names)}
    weights = train(windows, [index[x] for x in labels], len(names), net) if names else None
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        scorer = Scorer(shared.value, net) if shared.value is not None else None
        schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

        def rows():
            for batch in batches:
                texts = batch.column(1)
                lettered = [any(m.group().isalpha() for m in _LETTERS.finditer(t)) if (t := x.as_py()) else False for x in texts]
                raw = texts.fill_null("").cast(pa.large_binary())
                offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
                data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] else np.zeros(0, np.uint8)
                if scorer is None or not len(data):
                    probs = None
                else:
                    probs = scorer.texts(data, offsets)
                for i, key in enumerate(batch.column(0).to_pylist()):
                    if probs is None or not lettered[i]:
                        yield key, UNDETERMINED, 0.0
                    else:
                        k = int(probs[i].argmax())
                        yield key, names[k], float(min(1.0, probs[i][k]))

        yield from batches_of(rows(), schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_report(docs: DataFrame, net: ByteNet = PRODUCTION) -> DataFrame:
    """Prediction of every row; rows with remainder 1 modulo 3 are held out of training."""
    found = predicted(docs, docs.filter(fold(3) != 1), net)
    return found.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
