"""BAU against TEST: joined summaries, differences, order, rank, tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posrecon.functions.measures import (
    FAIL,
    PASS,
    abs_diff,
    classify_presence,
    pct_diff,
    within_tolerance,
)
from posrecon.operators import tagged
from posrecon.operators.skew import lookup_by_key, rows_before
from posrecon.shared import stored

_STORE_MEASURES = ("Units", "Totalprice")
#: Distinct values that one task ranks.
FEW_VALUES = 200_000
_ITEM_KEYS = ["UPC_CODE", "PRODUCT_DESCRIPTION"]


def full_join_with_coalesce(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    suffix: str = "_Test",
    fill_value: float = 0.0,
) -> DataFrame:
    """Full outer join with one key column; clashing right columns take ``suffix``
    and missing numbers become ``fill_value``.

    For summaries that exist already; rows of two sides are compared by one
    aggregation (:mod:`posrecon.operators.tagged`).
    """
    clash = [c for c in right.columns if c in left.columns and c not in on]
    right = right.withColumnsRenamed({c: c + suffix for c in clash})
    return left.join(right, on=list(on), how="full").fillna(fill_value)


def store_diffs(
    prod_summary: DataFrame, test_summary: DataFrame, ordered: bool = True
) -> DataFrame:
    """Store comparison: both sides' sums, differences and percent differences."""
    prod, test = (
        df.select(
            "STORE_NUMBER",
            *[
                (F.col(c) if c in df.columns else F.lit(0.0)).cast("double").alias(c)
                for c in _STORE_MEASURES
            ],
        )
        for df in (prod_summary, test_summary)
    )
    merged = full_join_with_coalesce(prod, test, ["STORE_NUMBER"]).withColumnsRenamed(
        {c: c + "_Prod" for c in _STORE_MEASURES}
    )
    return _store_columns(merged, ordered)


def _store_columns(merged: DataFrame, ordered: bool) -> DataFrame:
    out = merged.select(
        "STORE_NUMBER", "Units_Prod", "Totalprice_Prod", "Units_Test", "Totalprice_Test",
        abs_diff("Units_Prod", "Units_Test", "Units_Diff"),
        abs_diff("Totalprice_Prod", "Totalprice_Test", "Sales_Diff"),
        pct_diff("Units_Prod", "Units_Test").alias("Units_Diff_%"),
        pct_diff("Totalprice_Prod", "Totalprice_Test").alias("Sales_Diff_%"),
    )
    return out.orderBy("STORE_NUMBER") if ordered else out


def store_comparison_of(both: DataFrame, ordered: bool = True) -> DataFrame:
    """Store comparison from ``b_`` and ``t_`` sums per store."""
    names = {p + m: m + end for p, end in zip(tagged.SIDES, ("_Prod", "_Test")) for m in _STORE_MEASURES}
    sums = [F.coalesce(F.col(p), F.lit(0.0)).alias(n) for p, n in names.items()]
    return _store_columns(both.select("STORE_NUMBER", *sums), ordered)


def store_validation(
    prod_rows: DataFrame, test_rows: DataFrame, exact: bool | int = False, ordered: bool = True
) -> DataFrame:
    """Store comparison straight from canonical store rows: one aggregation of both sides."""
    both = tagged.both_sides(prod_rows, test_rows, ["STORE_NUMBER"], list(_STORE_MEASURES), exact)
    return store_comparison_of(both, ordered)


def item_comparison(bau_summary: DataFrame, test_summary: DataFrame) -> DataFrame:
    """Item comparison: presence class, differences and percent differences."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            *_ITEM_KEYS,
            F.col("UNITS_SOLD").cast("double").alias(f"{name} Units"),
            F.col("TOTAL_DOLLARS").cast("double").alias(f"{name} Dollars"),
        )

    return _item_columns(side(bau_summary, "BAU").join(side(test_summary, "TEST"), _ITEM_KEYS, "full"))


def item_comparison_of(both: DataFrame, units: str = "UNITS_SOLD", dollars: str = "TOTAL_DOLLARS") -> DataFrame:
    """Item comparison from ``b_`` and ``t_`` sums per (UPC, description)."""
    sums = [
        F.col(p + m).alias(f"{side} {name}")
        for p, side in zip(tagged.SIDES, ("BAU", "TEST"))
        for m, name in ((units, "Units"), (dollars, "Dollars"))
    ]
    return _item_columns(both.select(*_ITEM_KEYS, *sums))


def _item_columns(joined: DataFrame) -> DataFrame:
    filled = joined.withColumn("Present In", classify_presence("BAU Units", "TEST Units")).fillna(
        0.0, ["BAU Units", "BAU Dollars", "TEST Units", "TEST Dollars"]
    )
    return filled.select(
        *_ITEM_KEYS, "BAU Units", "BAU Dollars", "TEST Units", "TEST Dollars", "Present In",
        abs_diff("BAU Units", "TEST Units", "Units Difference"),
        abs_diff("BAU Dollars", "TEST Dollars", "Dollar Difference"),
        pct_diff("BAU Units", "TEST Units").alias("Unit % Difference"),
        pct_diff("BAU Dollars", "TEST Dollars").alias("Dollar % Difference"),
    )


create_comparison = item_comparison


def item_summary(comparison: DataFrame, ordered: bool = True) -> DataFrame:
    """Differences summed by presence class (three rows at most)."""
    out = comparison.groupBy("Present In").agg(
        F.sum("Units Difference").alias("Units Difference"),
        F.sum("Dollar Difference").alias("Dollar Difference"),
    )
    return out.orderBy("Present In") if ordered else out


def item_validation(
    bau_rows: DataFrame, test_rows: DataFrame, exact: bool | int = False
) -> tuple[DataFrame, DataFrame]:
    """Comparison and presence summary from canonical item rows: one aggregation of both sides."""
    both = tagged.both_sides(bau_rows, test_rows, _ITEM_KEYS, ["UNITS_SOLD", "TOTAL_DOLLARS"], exact)
    comparison = item_comparison_of(both)
    return comparison, item_summary(comparison)


def sort_by_diff(
    df: DataFrame, sort_col: str = "Units_Diff_%", ascending: bool = False,
    tiebreak: list[str] | None = None,
) -> DataFrame:
    """Order by a difference column; nulls come first either way.

    Give the key columns as ``tiebreak``: rows with one difference then spread over
    several ranges.
    """
    c = F.col(f"`{sort_col}`")
    first = c.asc_nulls_first() if ascending else c.desc_nulls_first()
    return df.orderBy(first, *[F.col(f"`{t}`") for t in tiebreak or []])


def top_by_diff(
    df: DataFrame, k: int, sort_col: str = "Units_Diff_%", ascending: bool = False,
    tiebreak: list[str] | None = None,
) -> DataFrame:
    """The ``k`` first rows of that order: per-task top k, then one merge of those."""
    c = F.col(f"`{sort_col}`")
    first = c.asc_nulls_first() if ascending else c.desc_nulls_first()
    return df.orderBy(first, *[F.col(f"`{t}`") for t in tiebreak or []]).limit(k)


def rank_by_diff(
    df: DataFrame,
    rank_col: str = "Units_Diff_%",
    rank_name: str = "Rank",
    ascending: bool = False,
) -> DataFrame:
    """Rank by a difference column, 1 = largest. Ties take the average of their
    ranks, cut to an integer; null has no rank.

    Rows are first reduced to distinct values with counts, so that neither a value
    shared by most rows nor the global order ends up in one task. ``df`` is computed
    once and stored, and so are its values; where these are few (``FEW_VALUES``, counted), one
    window ranks them and they are sent to every task.
    """
    df = stored(df)
    c = F.col(f"`{rank_col}`")
    values = stored(
        df.where(c.isNotNull()).groupBy(c.alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    )
    rank = F.floor(F.col("__before") + (F.col("__n") + 1) / 2).cast("int").alias(rank_name)
    if values.count() <= FEW_VALUES:
        order = F.col("__value").asc() if ascending else F.col("__value").desc()
        above = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        before = values.withColumn("__before", F.coalesce(F.sum("__n").over(above), F.lit(0)))
        ranks = before.select("__value", rank)
        return df.join(F.broadcast(ranks), c == F.col("__value"), "left").drop("__value")
    ranks = stored(rows_before(values, "__value", "__n", ascending).select("__value", "__n", rank))
    keyed = df.withColumn("__value", c)
    return lookup_by_key(keyed, ranks, "__value", rank_name, "__n").drop("__value")


def apply_tolerance(
    df: DataFrame,
    diff_col: str = "Units_Diff_%",
    tolerance: float = 5.0,
    status_col: str = "Status",
    pass_label: str = PASS,
    fail_label: str = FAIL,
) -> DataFrame:
    """Pass where the difference is within +-tolerance, else Fail (null: Fail)."""
    return df.withColumn(
        status_col, within_tolerance(F.col(f"`{diff_col}`"), tolerance, pass_label, fail_label)
    )
