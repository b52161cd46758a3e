"""Both sides in one aggregation.

Rows of the two sides are united; each measure takes one of two columns, by its side, and is null in the
other. One grouping then gives both sides' sums of every key next to each other, and a side without the key
shows as null. Compared with two summaries and a full join this is one shuffle, no sort, and one
aggregation. Rows with a null key stay apart by side, as an outer join leaves them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posrecon.functions.measures import decimals, exact_joined, exact_parts
from posrecon.sources.lines import FILE

#: Prefixes of the two sides' measures.
SIDES = ("b_", "t_")
APART = "__apart"
SIDE = "__side"

STORE = ["STORE_NUMBER"]
ITEM = ["UPC_CODE", "PRODUCT_DESCRIPTION"]


def _apart(keys: list[str]) -> Column:
    """The side, for rows that must not meet the other side's."""
    return F.when(reduce(lambda a, b: a | b, [F.col(f"`{k}`").isNull() for k in keys]), F.col(SIDE))


def united(sides: list[DataFrame], keys: list[str], measures: list[str], exact: bool | int = False) -> DataFrame:
    """Rows of all sides: keys, ``__side`` and each measure once per side.

    For exact sums a measure is its two parts, worked out once per row and not once per grouping set and side.
    """
    prefixes = SIDES[: len(sides)]

    def side(rows: DataFrame, k: int) -> DataFrame:
        own = {}
        for i, p in enumerate(prefixes):
            for m in measures:
                value = F.col(f"`{m}`").cast("double")
                names = _columns(p + m, exact)
                told = [value] if exact is False else exact_parts(value, decimals(exact))
                own |= {n: c if i == k else F.lit(None).cast("double" if exact is False else "long") for n, c in zip(names, told)}
        return rows.select(*keys, F.lit(k).alias(SIDE), *[c.alias(n) for n, c in own.items()])

    return reduce(lambda a, b: a.unionByName(b), [side(rows, k) for k, rows in enumerate(sides)])


def _columns(name: str, exact: bool | int) -> list[str]:
    return [name] if exact is False else [name + "__high", name + "__low"]


def _sums(n_sides: int, measures: list[str], exact: bool | int) -> list[Column]:
    """Sums of the measures of :func:`united` rows."""
    def one(name: str) -> Column:
        columns = [F.col(f"`{c}`") for c in _columns(name, exact)]
        return F.sum(*columns) if exact is False else exact_joined(*columns, decimals(exact))

    return [one(p + m).alias(p + m) for p in SIDES[:n_sides] for m in measures]


def both_sides(bau: DataFrame, test: DataFrame, keys: list[str], measures: list[str], exact: bool | int = False) -> DataFrame:
    """One row per key: the keys and ``b_`` / ``t_`` sums (null: the side does not have the key)."""
    rows = united([bau, test], keys, measures, exact).withColumn(APART, _apart(keys))
    return rows.groupBy(*keys, APART).agg(*_sums(2, measures, exact)).drop(APART)


# --- all levels of a run ------------------------------------------------------

_SALES = ["Units", "Totalprice", "TOTAL_DOLLARS"]


def run_summary(
    sides: list[DataFrame], exact: bool | int = False, stores: bool = True, items: bool = True, files: bool = False,
    one_price: bool = False,
) -> DataFrame:
    """Everything that a run's reports need, from one scan of the sales rows of its one or two sides.

    Levels: per store, per (UPC, description), and for reviews per (side, file, store) and (side, file, UPC).
    Take the parts with :func:`part`. A level that is not asked for is not formed. ``one_price`` says that store dollars
    are the item dollars on all sides: they are summed once, as ``TOTAL_DOLLARS``, and ``part`` gives both.

    Every row goes to each level under the same four keys (level, side, two names): a group is half as wide as one with a
    column per name. With files a row is in up to three groups that few rows share, too many to add up as the scan finds
    them, so rows are first dealt out by UPC in parts of bounded size; a part that one UPC fills is split.
    """
    keys = [*STORE, *ITEM, *([FILE] if files else [])]
    measures = [m for m in _SALES if m != "Totalprice" or not one_price]
    if files:
        sides = [rows.select(*keys, *measures).hint("rebalance", F.col("UPC_CODE")) for rows in sides]
    rows = united(sides, keys, measures, exact)
    none, side = F.lit(None).cast("string"), F.col(SIDE)
    store, upc, text, file = (F.col(c) if c in keys else none for c in (*STORE, *ITEM, FILE))
    told = {
        "store": (stores, _apart(STORE), store, none),
        "item": (items, _apart(ITEM), upc, text),
        "file_store": (files, side, file, store),
        "file_upc": (files, side, file, upc),
    }
    names = ["__level", APART, "__key1", "__key2"]
    each = [
        F.struct(*[c.alias(n) for n, c in zip(names, (F.lit(k), *columns))])
        for k, (wanted, *columns) in enumerate(told.values()) if wanted
    ]
    values = [c for p in SIDES[: len(sides)] for m in measures for c in _columns(p + m, exact)]
    dealt = rows.select(F.explode(F.array(*each)).alias("__k"), *values).select("__k.*", *values)
    sums = dealt.groupBy(*names).agg(*_sums(len(sides), measures, exact))
    level = F.element_at(F.array(*map(F.lit, told)), F.col("__level") + 1)
    of = lambda key, *levels: F.when(level.isin(*levels), F.col(key))
    own = {
        "level": level,
        "STORE_NUMBER": F.coalesce(of("__key1", "store"), of("__key2", "file_store")),
        "UPC_CODE": F.coalesce(of("__key1", "item"), of("__key2", "file_upc")),
        "PRODUCT_DESCRIPTION": of("__key2", "item"),
    }
    if files:
        own |= {FILE: of("__key1", "file_store", "file_upc"), SIDE: of(APART, "file_store", "file_upc")}
    return sums.withColumns(own).drop(*names)


def part(summary: DataFrame, level: str, side: int | None = None) -> DataFrame:
    """Rows of one level; with ``side`` those that this side has."""
    rows = summary.where(F.col("level") == level)
    dollars = {p: (p + "Totalprice", p + "TOTAL_DOLLARS") for p in SIDES}
    rows = rows.withColumns({new: F.col(old) for new, old in dollars.values() if old in summary.columns and new not in summary.columns})
    return rows if side is None else rows.where(F.col(SIDES[side] + "Units").isNotNull())


def key_counts_of(summary: DataFrame, names: list[str], files: bool) -> DataFrame:
    """Exact counts per side of the keys of a run: ``side``, ``stores``, ``upcs`` and ``files`` (null where the
    groups by file were not formed). A null key counts as none."""
    prefixes = SIDES[: len(names)]
    keys = {"store": ("stores", "STORE_NUMBER"), "item": ("upcs", "UPC_CODE")}
    keys |= {"file_store": ("files", FILE)} if files else {}
    # One chain of groupings: a union of parts of a cached table would not find the table in the cache.
    level, what, key = F.col("level"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (counted, column) in keys.items():
        what = F.when(level == name, counted).otherwise(what)
        key = F.when(level == name, F.col(column)).otherwise(key)
    rows = summary.select(what.alias("what"), key.alias("key"), *[F.col(p + "Units").isNotNull().alias(p) for p in prefixes])
    distinct = rows.where(F.col("key").isNotNull()).groupBy("what", "key").agg(*[F.bool_or(p).alias(p) for p in prefixes])
    counts = distinct.groupBy("what").agg(*[F.count_if(p).alias(p) for p in prefixes])
    each = [F.struct(F.lit(side).alias("side"), F.col(p).alias("n")) for side, p in zip(names, prefixes)]
    of = lambda name: F.coalesce(F.max(F.when(F.col("what") == name, F.col("n"))), F.lit(0)).alias(name)
    told = counts.select("what", F.explode(F.array(*each)).alias("x")).select("what", "x.*").groupBy("side")
    return told.agg(of("stores"), of("upcs"), of("files") if files else F.lit(None).cast("long").alias("files"))
