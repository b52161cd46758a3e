"""Mixing sources to target weights by pivotal dependent rounding.

Sources share all words by weight. A source can be taken at most ``most`` times; what lies above that goes to the
others by weight, until none is above. A source's rate (target / size) gives every document a number of copies
that is mostly not whole. Whole copies are certain; the fractions are rounded in pairs: words move from one
document's fraction to the other's until one of the two is whole. The direction is drawn so that each
fraction keeps its expectation, and the words of both together stay the same, so the source keeps its target. Pairs are
taken along small groups of documents; what stays fractional of each group meets the others' in the next
level, a tree of as many levels as the largest source needs. Of the last document of a source the
fraction stays, and so many of its words are taken (its first ones), so a source misses its target by half a word at most.

Only built-in functions run. Draws are hashes of ids and sizes, so runs agree whatever the partitioning.
Documents with the same id, source and size are one entry with a count: copies go to its rows in equal
shares, and no id holds up a task. A null text has no words; a document without words is taken with 0; a
null source is a source (the last), a null id an id; an empty table gives an empty result. Texts of any length count
as they are. Columns other than id, text and source are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from posrecon.llm.common import SPACES, let, saved
from posrecon.operators.skew import lookup_by_key, rows_before

#: Fractions closer to a whole number than this are that number.
EXACT = 1e-12
#: Rows of one repeated document that one task writes at a time.
LOT = 4096


@dataclass(frozen=True)
class Mix:
    #: Weights of the sources in order, repeating.
    weights: tuple[int, ...] = (1, 2, 3)
    #: A source is taken at most so many times.
    most: int = 3
    #: Documents that meet in one group of the tree, about.
    group: int = 48
    seed: int = 13


PRODUCTION = Mix()


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``: each, with the spaces after it, becomes one letter."""
    inner = F.ltrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.length(F.regexp_replace(inner, "[^ \\t-\\r]++[ \\t-\\r]*+", "w")).cast("long")


def _wide(c: Column | int) -> Column:
    return (c if isinstance(c, Column) else F.lit(str(c))).cast("decimal(19,0)")


def source_targets(items: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """``key``, ``n``, ``source_size``, ``weight``, ``rate`` and ``target`` per source.

    ``items`` have ``key`` (orders the sources), ``size`` and ``m`` (rows). Shares are exact
    fractions; each round of resharing asks the table of sources for one row.
    """
    sizes = saved(
        items.groupBy("key").agg(
            F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n")
        ).withColumn("one", F.lit(1).cast("long"))
    )
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.col("__before") % len(mix.weights) + 1).cast("int"))
    ranked = saved(rows_before(sizes, "key", "one", True).select("key", "n", "source_size", weight.alias("weight")))
    most, total = F.col("source_size") * mix.most, F.sum("source_size")
    words, share = (int(x or 0) for x in ranked.agg(total, F.sum("weight")).first())
    all_words, all_share, full = words, share, None
    while True:
        # One unit of weight gets words / share; sources that cannot take theirs are full.
        is_full = _wide(most) * _wide(share) <= _wide(words) * _wide(F.col("weight")) if share else F.lit(True)
        held = ranked.where(is_full).agg(F.sum(most), F.sum("weight"), F.count(F.lit(1))).first()
        if held[2] == full:
            break
        full = held[2]
        words, share = all_words - int(held[0] or 0), all_share - int(held[1] or 0)
    part = F.col("weight").cast("double") * float(words) / float(share or 1)
    target = F.when(is_full, most.cast("double")).otherwise(part)
    rate = F.when(F.col("source_size") == 0, 0.0).when(is_full, float(mix.most)).otherwise(part / F.col("source_size"))
    return ranked.select("key", "n", "source_size", "weight", rate.alias("rate"), target.alias("target"))


def _uniform(*values: Column) -> Column:
    """A number in [0, 1) drawn from the values."""
    return F.shiftrightunsigned(F.xxhash64(*values), 11) * F.lit(2.0**-53)


def _near(p: Column) -> Column:
    return F.when(p <= EXACT, 0.0).when(p >= 1 - EXACT, 1.0).otherwise(p)


def _is_open(p: Column) -> Column:
    return (p > 0) & (p < 1)


def _paired(one: Column, two: Column, seed: int) -> Column:
    """The fractions of two documents after words moved between them: at least one is whole."""
    a, p, b, q = one["size"], one["p"], two["size"], two["p"]

    def moved(to_one: Column, to_two: Column) -> Column:
        up = _uniform(F.lit(seed), one["h"], two["h"]) * (to_one + to_two) < to_two
        full, empty = a * (1 - p) <= b * q, a * p <= b * (1 - q)
        return F.struct(
            F.when(up, F.when(full, 1.0).otherwise(_near(p + to_one / a)))
            .otherwise(F.when(empty, 0.0).otherwise(_near(p - to_two / a)))
            .alias("p"),
            F.when(up, F.when(b * q <= a * (1 - p), 0.0).otherwise(_near(q - to_one / b)))
            .otherwise(F.when(b * (1 - q) <= a * p, 1.0).otherwise(_near(q + to_two / b)))
            .alias("q"),
        )

    return let(
        F.struct(F.least(a * (1 - p), b * q).alias("up"), F.least(a * p, b * (1 - q)).alias("down")),
        lambda x: moved(x["up"], x["down"]),
    )


_ENTRY = "struct<h:bigint,doc_id:bigint,size:bigint,m:bigint,base:bigint,p:double>"


def _rounded_along(entries: Column, seed: int) -> Column:
    """All entries after rounding in pairs along the array; at most one fraction stays open, the last."""

    def with_p(entry: Column, p: Column) -> Column:
        return F.struct(*(entry[c].alias(c) for c in ("h", "doc_id", "size", "m", "base")), p.alias("p"))

    def step(state: Column, entry: Column) -> Column:
        held, done = state["held"], state["done"]

        def settled(pair: Column) -> Column:
            one, two = with_p(held, pair["p"]), with_p(entry, pair["q"])
            return (
                F.when(_is_open(pair["p"]), F.struct(one.alias("held"), F.array_append(done, two).alias("done")))
                .when(_is_open(pair["q"]), F.struct(two.alias("held"), F.array_append(done, one).alias("done")))
                .otherwise(F.struct(F.lit(None).cast(_ENTRY).alias("held"), F.concat(done, F.array(one, two)).alias("done")))
            )

        return F.when(held.isNull(), F.struct(entry.alias("held"), done.alias("done"))).otherwise(
            let(_paired(held, entry, seed), settled)
        )

    start = F.struct(F.lit(None).cast(_ENTRY).alias("held"), F.array().cast(f"array<{_ENTRY}>").alias("done"))
    return F.aggregate(
        entries, start.cast(f"struct<held:{_ENTRY},done:array<{_ENTRY}>>"),
        lambda s, e: step(s, e).cast(f"struct<held:{_ENTRY},done:array<{_ENTRY}>>"),
        lambda s: F.array_compact(F.array_append(s["done"], s["held"])),
    )


def _rounded(entries: DataFrame, largest: int, mix: Mix) -> DataFrame:
    """``entries`` (source ``s``, number of groups ``nodes``, ``h``, ...) with ``p`` 0 or 1, but for one per source."""
    columns = ["h", "doc_id", "size", "m", "base", "p"]
    level = entries.withColumn("node", F.pmod("h", "nodes"))
    nodes, settled, depth = max(1, largest), [], 0
    while True:
        told = level.groupBy("s", "nodes", "node").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("all"))
        told = told.withColumn("one", F.explode(_rounded_along(F.col("all"), mix.seed + depth)))
        told = saved(told.select("s", "nodes", "node", "one.*"))
        if nodes == 1:
            return _union([*settled, told.select("s", *columns)])
        settled.append(told.where(~_is_open(F.col("p"))).select("s", *columns))
        nodes, depth = -(-nodes // mix.group), depth + 1
        upper = F.ceil(F.col("nodes") / mix.group).cast("long")
        level = told.where(_is_open(F.col("p"))).select(
            "s", upper.alias("nodes"), F.floor(F.col("node") / mix.group).cast("long").alias("node"), *columns
        )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mix: Mix = PRODUCTION
) -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``
    (whole ones) and ``taken`` (words, with those of the one document per source that is cut)."""
    source = F.col(source_col).cast("string")
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)).alias("key"),
        word_count(F.col(text_col).cast("string")).alias("size"),
    )
    items = saved(sized.groupBy("key", "doc_id", "size").agg(F.count(F.lit(1)).alias("m")))
    targets = saved(source_targets(items, mix).withColumn("s", F.xxhash64("key")))
    info = targets.select(
        "key", "n", F.struct("s", "rate", F.ceil(F.col("n") / mix.group).cast("long").alias("nodes")).alias("info")
    )
    copies = F.col("m") * F.col("info.rate")
    entries = saved(
        lookup_by_key(items, info, "key", "info", "n")
        .withColumn("base", F.floor(copies + EXACT).cast("long"))
        .select(
            "key", F.col("info.nodes").alias("nodes"), "doc_id", "size", "m", "base",
            F.xxhash64(F.lit(mix.seed), "key", "doc_id", "size").alias("h"),
            F.when(F.col("size") == 0, 0.0).otherwise(_near(F.greatest(copies - F.col("base"), F.lit(0.0)))).alias("p"),
        )
    )
    largest = targets.agg(F.max("n")).first()[0] or 0
    tree = _rounded(
        entries.where(_is_open(F.col("p"))).withColumnRenamed("key", "s"), -(-largest // mix.group), mix
    )
    rest = entries.where(~_is_open(F.col("p"))).select(F.col("key").alias("s"), "h", "doc_id", "size", "m", "base", "p")
    return _rows(tree.unionByName(rest), targets)


def _rows(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """An entry as its ``m`` rows; copies in equal shares, the first rows one more."""
    whole = F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(F.col("base") + F.floor("p"))
    cut = F.round(F.col("size") * (F.col("p") - F.floor("p"))).cast("long")
    told = entries.select("s", "h", "doc_id", "size", "m", whole.alias("whole"), cut.alias("cut"))
    many = told.where(F.col("m") > LOT)
    lots = many.withColumn("lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / LOT)))).repartition("h", "lot")
    lots = told.where(F.col("m") <= LOT).withColumn("lot", F.lit(0).cast("long")).unionByName(lots)
    first = F.col("lot") * LOT
    row = F.explode(F.sequence(first, F.least(first + LOT, F.col("m")) - 1))
    each, more = F.floor(F.col("whole") / F.col("m")), F.col("whole") % F.col("m")
    mine = (each + F.when(F.col("row") < more, 1).otherwise(0)).cast("long")
    rows = lots.withColumn("row", row).select(
        F.col("s").alias("key"), "doc_id", "size", mine.alias("copies"),
        (F.col("size") * mine + F.when(F.col("row") == more, F.col("cut")).otherwise(0)).alias("taken"),
    )
    facts = targets.select("key", "n", F.struct("source_size", "target").alias("facts"))
    return lookup_by_key(rows, facts, "key", "facts", "n").select(
        "doc_id", F.when(F.col("key") != "1", F.substring("key", 2, 1 << 30)).alias("source"), "size",
        F.col("facts.source_size").alias("source_size"), F.col("facts.target").alias("target"), "copies", "taken",
    )


def mix_report(docs: DataFrame) -> DataFrame:
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")
