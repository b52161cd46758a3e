"""Which stores one side has and the other lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posrecon.functions.text import strip
from posrecon.operators import tagged

MISSING_IN_TEST = "missing_in_test"
MISSING_IN_PROD = "missing_in_prod"


def store_list_diff(
    prod: DataFrame,
    test: DataFrame,
    prod_col: str = "STORE_NUMBER",
    test_col: str = "STORE_NUMBER",
) -> DataFrame:
    """``(side, store)``: trimmed, lower-cased stores that the other side lacks.

    One grouping over both lists finds both directions; duplicates shrink to one
    partial row per task before the shuffle.
    """

    def stores(df: DataFrame, name: str, in_prod: bool) -> DataFrame:
        return df.select(_plain(name), F.lit(in_prod).alias("in_prod"), F.lit(not in_prod).alias("in_test"))

    return _missing(stores(prod, prod_col, True).unionByName(stores(test, test_col, False)))


def store_list_of(both: DataFrame) -> DataFrame:
    """The same from ``b_`` and ``t_`` sums per store: one table, read once."""
    has = [F.col(p + "Units").isNotNull().alias(name) for p, name in zip(tagged.SIDES, ("in_prod", "in_test"))]
    return _missing(both.select(_plain("STORE_NUMBER"), *has))


def _plain(name: str) -> Column:
    return F.lower(strip(F.col(f"`{name}`").cast("string"))).alias("store")


def _missing(rows: DataFrame) -> DataFrame:
    seen = rows.where(F.col("store").isNotNull()).groupBy("store").agg(
        F.bool_or("in_prod").alias("in_prod"), F.bool_or("in_test").alias("in_test")
    )
    return seen.where(F.col("in_prod") != F.col("in_test")).select(
        F.when(F.col("in_prod"), MISSING_IN_TEST).otherwise(MISSING_IN_PROD).alias("side"), "store"
    )


def store_list_text(diff: DataFrame) -> DataFrame:
    """``(side, store, n_stores)``: each missing store with the number its side lacks.

    One row per store at any size, in place of one joined string per side.
    """
    totals = diff.groupBy("side").agg(F.count(F.lit(1)).alias("n_stores"))
    return diff.join(F.broadcast(totals), "side")  # at most two rows
