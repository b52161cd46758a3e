"""Sums of units and dollars by store, item or UPC."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posrecon.config import LEVELS, FormatConfig, ValidationRule
from posrecon.functions.measures import total
from posrecon.operators.canonical import to_rows

def _level(level: str) -> tuple[list[str], list[str]]:
    if level not in LEVELS:
        raise ValueError(f"Unknown aggregation level: {level}")
    return LEVELS[level]


def summarize(
    rows: DataFrame, keys: list[str], sums: list[str], exact: bool | int = False
) -> DataFrame:
    """``groupBy(keys)`` with a sum per measure. Partial sums form before the shuffle,
    so a hot key costs one partial row per task."""
    return rows.groupBy(*keys).agg(*sum_columns(sums, exact))


def sum_columns(sums: list[str], exact: bool | int = False) -> list[Column]:
    """The aggregates of :func:`summarize`, to be made once where it runs often."""
    return [total(F.col(f"`{c}`"), exact).alias(c) for c in sums]


def summarize_level(
    rows: DataFrame, level: str, exact: bool | int = False, ordered: bool = False
) -> DataFrame:
    """Summary of canonical rows. ``ordered`` sorts by key (never for UPC); leave it
    off where a join follows."""
    keys, sums = _level(level)
    out = summarize(rows, keys, sums, exact)
    return out.orderBy(*keys) if ordered and level != "upc" else out


def aggregate(
    df: DataFrame, level: str, config: FormatConfig, exact: bool | int = False, ordered: bool = True
) -> DataFrame:
    """Raw columns to the summary of one level."""
    _level(level)
    return summarize_level(to_rows(df, level, config), level, exact, ordered)


def merge_summaries(
    summaries: list[DataFrame], level: str = "store", exact: bool | int = False
) -> DataFrame:
    """Add stored summaries together, e.g. a new day's to the running one."""
    if not summaries:
        raise ValueError("nothing to merge")
    keys, _ = _level(level)
    both = reduce(lambda a, b: a.unionByName(b), summaries)
    return summarize(both, keys, _level(level)[1], exact)


def aggregate_by_rule(
    rows: DataFrame, rule: ValidationRule, level: str, exact: bool | int = False
) -> DataFrame:
    """Group and sum by the rule's columns, or by the level's where it names none."""
    keys, sums = _level(level)
    missing = [c for c in rule.required_columns if c not in rows.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    return summarize(
        rows, rule.group_by_columns or keys, rule.aggregation_columns or sums, exact
    )


def aggregate_by_rules(
    rows: DataFrame, rules: dict[str, ValidationRule], level: str, exact: bool | int = False
) -> DataFrame:
    """Many rules in one pass: ``rule``, every grouping column of any rule, and every sum of any rule.

    Rules become grouping sets over one scan; those with the same columns share a set. Columns that a rule does not
    group by or sum are null in its rows; :func:`rule_part` takes one rule's table out.
    """
    keys, sums = _level(level)
    missing = sorted({c for r in rules.values() for c in r.required_columns if c not in rows.columns})
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    groups = {name: tuple(r.group_by_columns or keys) for name, r in rules.items()}
    adds = {name: tuple(r.aggregation_columns or sums) for name, r in rules.items()}
    every = list(dict.fromkeys(c for g in groups.values() for c in g))
    measures = list(dict.fromkeys(c for a in adds.values() for c in a))
    if set(every) & set(measures):
        raise ValueError(f"grouped and summed: {', '.join(sorted(set(every) & set(measures)))}")
    sets: dict[frozenset, list[str]] = {}
    for name, g in groups.items():
        sets.setdefault(frozenset(g), []).append(name)
    told = rows.groupingSets([[F.col(f"`{c}`") for c in every if c in g] for g in sets], *[F.col(f"`{c}`") for c in every]).agg(
        F.grouping_id().alias("__id"), *[total(F.col(f"`{c}`"), exact).alias(c) for c in measures]
    )
    named = None
    for g, names in sets.items():
        number = sum(1 << k for k, c in enumerate(reversed(every)) if c not in g)
        own = F.array(*map(F.lit, names))
        named = F.when(F.col("__id") == number, own) if named is None else named.when(F.col("__id") == number, own)
    long = told.withColumn("rule", F.explode(named))
    asked = lambda c: F.col("rule").isin([name for name, a in adds.items() if c in a])
    return long.select("rule", *[F.col(f"`{c}`") for c in every], *[F.when(asked(c), F.col(f"`{c}`")).alias(c) for c in measures])


def rule_part(table: DataFrame, name: str, rule: ValidationRule, level: str) -> DataFrame:
    """The rows of one rule with its own columns."""
    keys, sums = _level(level)
    return table.where(F.col("rule") == name).select(*(rule.group_by_columns or keys), *(rule.aggregation_columns or sums))


def two_level_summary(sales: DataFrame, exact: bool | int = False) -> DataFrame:
    """Store and item sums from one pass over sales rows.

    Grouping sets feed both groupings from the same scan; :func:`store_part` and
    :func:`item_part` take them apart again.
    """
    sets = [
        [F.col("STORE_NUMBER")],
        [F.col("UPC_CODE"), F.col("PRODUCT_DESCRIPTION")],
    ]
    return sales.groupingSets(sets, "STORE_NUMBER", "UPC_CODE", "PRODUCT_DESCRIPTION").agg(
        F.grouping("STORE_NUMBER").alias("is_item"),
        total("Units", exact).alias("Units"),
        total("Totalprice", exact).alias("Totalprice"),
        total("TOTAL_DOLLARS", exact).alias("TOTAL_DOLLARS"),
    )


def store_part(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("is_item") == 0).select("STORE_NUMBER", "Units", "Totalprice")


def item_part(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("is_item") == 1).select(
        "UPC_CODE", "PRODUCT_DESCRIPTION", F.col("Units").alias("UNITS_SOLD"), "TOTAL_DOLLARS"
    )
