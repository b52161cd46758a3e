"""Quality rules with thresholds that follow the data.

Each document is measured (mean word length, symbols, repeated lines, repeated words,
capitals, exclamation marks, all as whole numbers per thousand). The measures of every
(language, source) go into quantile sketches: counts per bucket, where a bucket keeps the
five leading bits of the value after its first, so a quantile is off by 1/32 at most. Sketches merge by adding
counts, which is how a pair with few documents takes the sketch of its language, and a
rare language the one of all documents. A document is kept if every measure lies inside
the fences that the sketch gives: quartiles -/+ ``reach`` times their distance (and at
least ``reach`` times a smallest distance).

Only built-in functions run. Texts of any length are measured whole, in memory that grows with the number of words. A null text counts as empty; null languages and sources
are groups of their own; repeated rows are judged like any others; an empty table gives
an empty result. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from posrecon.llm.common import SPACES, let, saved, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Thresholds of at most so many groups are sent to every task.
BROADCAST_GROUPS = 20_000


@dataclass(frozen=True)
class Fence:
    """How far a measure may lie from the middle half of its group.

    ``spread`` is the smallest distance of the quartiles that is believed.
    """

    measure: str
    spread: int
    low: bool = False


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_pct: int = 20
    reach: int = 6
    #: Smaller groups use the sketch of their language, and smaller languages that of all.
    min_docs: int = 100
    fences: tuple[Fence, ...] = (
        Fence("word_length", 50, low=True),
        Fence("symbol_rate", 15),
        Fence("dup_line_rate", 100),
        Fence("repeat_rate", 33),
        Fence("capital_rate", 20),
        Fence("exclaim_rate", 15),
    )


PRODUCTION = Rules()


def _n_repeat_words(words: Column) -> Column:
    """Words inside a window of five that the text holds at least twice."""
    windows = lambda ws: F.transform(
        F.sequence(F.lit(0), F.size(ws) - WINDOW),
        lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(WINDOW))),
    )

    def covered(found: Column) -> Column:
        steps = F.transform(
            found, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(found, k + 1) - p, F.lit(WINDOW)))
        )
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def repeated(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(
            s,
            lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
        )
        positions = lambda s: F.sort_array(F.transform(again(s), lambda x: x["i"]))
        return F.when(
            F.size(F.array_distinct(h)) < F.size(h),
            let(placed, lambda s: let(positions(s), covered)),
        ).otherwise(0)

    return let(
        words,
        lambda ws: F.when(F.size(ws) > WINDOW, let(windows(ws), repeated)).otherwise(0),
    ).cast("long")


def _without(text: Column, pattern: str) -> Column:
    """Length without what matches; a replaced pattern is far cheaper than ``translate``."""
    return F.length(F.regexp_replace(text, pattern, ""))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``m_`` of counts and rates; nothing else is added."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(SPACES)) != "")
    line_counts = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")
        ),
    )
    word_counts = let(
        words_of(F.col("text")),
        lambda ws: F.struct(F.size(ws).cast("long").alias("n"), _n_repeat_words(ws).alias("again")),
    )
    chars = F.length(text)
    counts = docs.select(
        F.struct("*").alias("row_"),
        word_counts.alias("w"),
        line_counts.alias("l"),
        _without(text, "[ \\t-\\r]+").cast("long").alias("word_chars"),
        (chars - _without(text, f"[{SYMBOLS}]+")).cast("long").alias("n_symbols"),
        (chars - _without(text, "\\p{Lu}+")).cast("long").alias("capitals"),
        (chars - _without(text, "!+")).cast("long").alias("exclaims"),
    )
    n = F.col("w.n")
    rates = F.struct(
        n.alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"),
        F.col("w.again").alias("n_repeat_words"),
        F.expr("100 * word_chars div greatest(w.n, 1)").alias("word_length"),
        F.expr("1000 * n_symbols div greatest(w.n, 1)").alias("symbol_rate"),
        F.expr("1000 * l.dup div greatest(l.n, 1)").alias("dup_line_rate"),
        F.expr("1000 * w.again div greatest(w.n, 1)").alias("repeat_rate"),
        F.expr("1000 * capitals div greatest(word_chars, 1)").alias("capital_rate"),
        F.expr("1000 * exclaims div greatest(w.n, 1)").alias("exclaim_rate"),
    )
    return counts.select("row_.*", rates.alias("m_"))


def _bucket(v: Column) -> Column:
    """The value with its six leading bits only."""
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(v)) - 6, F.lit(0))).cast("long")
    return v - v % step


def sketches(rows: DataFrame, rules: Rules = PRODUCTION) -> DataFrame:
    """(lang, source, measure, bucket, n) from the columns ``lang``, ``source``, ``m_``."""
    names = [f.measure for f in rules.fences]
    entries = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), _bucket(F.col(f"m_.{m}")).alias("bucket")) for m in names)))
    return (
        rows.select("lang", "source", entries.alias("e"))
        .groupBy("lang", "source", "e.measure", "e.bucket")
        .agg(F.count("*").alias("n"))
    )


def thresholds(sketch: DataFrame, rules: Rules = PRODUCTION) -> DataFrame:
    """One row per (lang, source) with ``low`` and ``high`` per measure."""
    levels = {"own": ["lang", "source"], "lang": ["lang"], "all": []}
    quartiles = {}
    for name, keys in levels.items():
        merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys, "measure")
        ranked = merged.select(
            "*",
            F.sum("n").over(w).alias("total"),
            F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        )
        at = lambda pct: F.min(F.when(F.col("upto") * 100 >= F.col("total") * pct, F.col("bucket")))
        quartiles[name] = ranked.groupBy(*keys, "measure").agg(
            F.max("total").alias(f"n_{name}"), F.struct(at(25).alias("q1"), at(75).alias("q3")).alias(f"q_{name}")
        )
    own, lang, every = quartiles.values()
    lang = lang.withColumnsRenamed({"lang": "lang_", "measure": "measure_"})
    every = every.withColumnRenamed("measure", "measure_a")
    joined = own.join(lang, own.lang.eqNullSafe(lang.lang_) & (own.measure == lang.measure_)).join(
        F.broadcast(every), own.measure == every.measure_a  # one row per measure
    )
    q = F.when(F.col("n_own") >= rules.min_docs, F.col("q_own")).when(
        F.col("n_lang") >= rules.min_docs, F.col("q_lang")
    ).otherwise(F.col("q_all"))
    spread = F.create_map(*(F.lit(x) for f in rules.fences for x in (f.measure, f.spread)))
    two_sided = [f.measure for f in rules.fences if f.low]
    width = rules.reach * F.greatest(q["q3"] - q["q1"], spread[F.col("measure")])
    fence = F.struct(
        F.when(F.col("measure").isin(two_sided), q["q1"] - width).alias("low"), (q["q3"] + width).alias("high")
    )
    names = [f.measure for f in rules.fences]
    picked = [F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(m) for m in names]
    return (
        joined.select("lang", "source", "measure", fence.alias("fence"))
        .groupBy("lang", "source")
        .agg(F.struct(*picked).alias("f_"))
    )


def base_failed(rules: Rules = PRODUCTION) -> Column:
    n, again = F.col("m_.n_words"), F.col("m_.n_repeat_words")
    return (n < rules.min_words) | (again * 100 > n * rules.max_repeat_pct)


def with_verdict(rows: DataFrame, rules: Rules = PRODUCTION, sketch: DataFrame | None = None) -> DataFrame:
    """``rows`` (with ``m_``) plus ``kept_``: the join with the fences of their group."""
    limits = saved(thresholds(sketch if sketch is not None else sketches(rows, rules), rules))
    if limits.count() <= BROADCAST_GROUPS:  # else a shuffled join, whose hot groups Spark splits
        limits = F.broadcast(limits)
    limits = limits.withColumnsRenamed({"lang": "lang_f", "source": "source_f"})
    inside = F.lit(True)
    for f in rules.fences:
        low, high = F.col(f"f_.{f.measure}.low"), F.col(f"f_.{f.measure}.high")
        v = F.col(f"m_.{f.measure}")
        inside = inside & (v <= high) & (v >= F.coalesce(low, v))
    kept = ~base_failed(rules) & inside
    left = rows.alias("r")
    on = F.col("r.lang").eqNullSafe(F.col("lang_f")) & F.col("r.source").eqNullSafe(F.col("source_f"))
    return left.join(limits, on, "left").select("r.*", F.coalesce(kept, F.lit(False)).alias("kept_"))


def quality_report(docs: DataFrame, rules: Rules = PRODUCTION) -> DataFrame:
    """Counts, base check and verdict of every document, one row per row of ``docs``."""
    rows = saved(measured(docs.select("doc_id", "text", "lang", "source")).drop("text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return with_verdict(rows, rules).select(
        "doc_id", *(F.col(f"m_.{c}").alias(c) for c in counts), base_failed(rules).alias("base_failed"),
        F.col("kept_").alias("kept"),
    )


def keep_good(docs: DataFrame, rules: Rules = PRODUCTION) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only.

    Texts are measured twice (for the sketches and for the verdict) so that they need no
    shuffle.
    """
    nested = docs.select("text", "lang", "source", F.struct("*").alias("doc_"))
    rows = measured(nested)
    kept = with_verdict(rows, rules, saved(sketches(measured(docs.select("text", "lang", "source")), rules)))
    return kept.filter("kept_").select("doc_.*")
