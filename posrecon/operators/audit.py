"""Item audit: how the two sides' (UPC, description) keys agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posrecon.functions.measures import (
    IN_BOTH,
    ONLY_BAU,
    ONLY_TEST,
    classify_presence,
    coerce_numeric,
    fraction_change,
    total,
)
from posrecon.operators import tagged
from posrecon.operators.skew import lookup_by_key

KEYS = ["UPC_CODE", "PRODUCT_DESCRIPTION"]


def audit_summary(rows: DataFrame, exact: bool | int = False) -> DataFrame:
    """Sums per (UPC, description) of one side's row-level output; bad numbers count
    as 0 and rows with a null key are left out."""
    return audit_rows(rows).groupBy(*KEYS).agg(total("Units", exact).alias("UNITS"), total("Dollars", exact).alias("DOLLARS"))


def audit_rows(rows: DataFrame) -> DataFrame:
    """Row-level output as keys, ``Units`` and ``Dollars``."""
    return rows.select(
        *KEYS, coerce_numeric("UNITS_SOLD").alias("Units"), coerce_numeric("TOTAL_DOLLARS").alias("Dollars")
    ).where(F.col("UPC_CODE").isNotNull() & F.col("PRODUCT_DESCRIPTION").isNotNull())


def presence_of_rows(bau: DataFrame, test: DataFrame, exact: bool | int = False) -> DataFrame:
    """All keys with their presence class from both sides' row-level output, by one aggregation."""
    both = tagged.both_sides(audit_rows(bau), audit_rows(test), KEYS, ["Units", "Dollars"], exact)
    sums = [F.col(p + m).alias(f"{side} {m}") for p, side in zip(tagged.SIDES, ("BAU", "TEST")) for m in ("Units", "Dollars")]
    return both.select(*KEYS, *sums).withColumn("Present In", classify_presence("BAU Units", "TEST Units"))


def _side(summary: DataFrame, name: str) -> DataFrame:
    return summary.select(
        *KEYS, F.col("UNITS").alias(f"{name} Units"), F.col("DOLLARS").alias(f"{name} Dollars")
    )


def differences_of(presence: DataFrame) -> DataFrame:
    """Keys on both sides: TEST - BAU differences and fractional changes."""
    return presence.where(F.col("BAU Units").isNotNull() & F.col("TEST Units").isNotNull()).select(
        *KEYS, "BAU Units", "BAU Dollars", "TEST Units", "TEST Dollars",
        (F.col("TEST Units") - F.col("BAU Units")).alias("Units Difference"),
        (F.col("TEST Dollars") - F.col("BAU Dollars")).alias("Dollar Difference"),
        fraction_change("BAU Units", "TEST Units").alias("Unit % Difference"),
        fraction_change("BAU Dollars", "TEST Dollars").alias("Dollar % Difference"),
    )


def inner_differences(bau: DataFrame, test: DataFrame) -> DataFrame:
    """The same from the sums of the two sides."""
    return differences_of(_side(bau, "BAU").join(_side(test, "TEST"), KEYS))


def outer_presence(bau: DataFrame, test: DataFrame) -> DataFrame:
    """All keys with their presence class; measures of the absent side stay null."""
    return (
        _side(bau, "BAU")
        .join(_side(test, "TEST"), KEYS, "full")
        .withColumn("Present In", classify_presence("BAU Units", "TEST Units"))
    )


def only_in(presence: DataFrame, label: str) -> DataFrame:
    return presence.where(F.col("Present In") == label)


def key_counts(presence: DataFrame) -> DataFrame:
    """Number of keys only in BAU, only in TEST and in both."""
    where = F.col("Present In")
    return presence.agg(
        F.count_if(where == ONLY_BAU).alias("bau_only"),
        F.count_if(where == ONLY_TEST).alias("test_only"),
        F.count_if(where == IN_BOTH).alias("both"),
    )


def upc_agreement(presence: DataFrame) -> DataFrame:
    """Per UPC: descriptions per side, shared descriptions, sums, and the number of
    (BAU, TEST) description pairs that differ.

    The pairs are counted, not formed: n_bau * n_test - n_shared.
    """
    bau = F.count("BAU Units")
    test = F.count("TEST Units")
    shared = F.count_if(F.col("Present In") == IN_BOTH)
    return presence.groupBy("UPC_CODE").agg(
        bau.alias("n_bau"),
        test.alias("n_test"),
        shared.alias("n_shared"),
        (bau * test - shared).alias("mismatched_pairs"),
        F.sum("BAU Units").alias("BAU_TOTAL_UNITS"),
        F.sum("TEST Units").alias("TEST_TOTAL_UNITS"),
        F.sum("BAU Dollars").alias("BAU_TOTAL_DOLLARS"),
        F.sum("TEST Dollars").alias("TEST_TOTAL_DOLLARS"),
    )


def common_upcs(agreement: DataFrame) -> DataFrame:
    """UPCs that both sides have."""
    return agreement.where((F.col("n_bau") > 0) & (F.col("n_test") > 0))


def disjoint_upcs(agreement: DataFrame) -> DataFrame:
    """UPCs on both sides that share no description."""
    return common_upcs(agreement).where(F.col("n_shared") == 0)


def _with_counts(presence: DataFrame, upcs: DataFrame) -> DataFrame:
    """Key rows of the given UPCs with ``n_bau`` and ``n_test``; UPCs with very many
    descriptions do not gather in one task."""
    counts = upcs.select(
        "UPC_CODE",
        F.struct("n_bau", "n_test").alias("__counts"),
        (F.col("n_bau") + F.col("n_test")).alias("__n"),
    )
    found = lookup_by_key(presence, counts, "UPC_CODE", "__counts", "__n")
    return found.where(F.col("__counts").isNotNull()).select(*presence.columns, "__counts.*")


def description_mismatch(presence: DataFrame, agreement: DataFrame) -> DataFrame:
    """Description rows of UPCs whose descriptions differ between the sides.

    One row per side and description with ``partners``, the number of the other
    side's descriptions it differs from. Rows grow with the input; the pairs of a
    UPC are each BAU row with each TEST row of another description.
    """
    keys = _with_counts(presence, agreement.where(F.col("mismatched_pairs") > 0))
    in_both = (F.col("Present In") == IN_BOTH).cast("long")
    sides = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(side).alias("side"),
                    F.col(f"{side} Units").alias("units"),
                    F.col(f"{side} Dollars").alias("dollars"),
                    (F.col(f"n_{other}") - in_both).alias("partners"),
                )
                for side, other in (("BAU", "test"), ("TEST", "bau"))
            ]
        )
    )
    return (
        keys.select(*KEYS, sides.alias("s"))
        .select(*KEYS, "s.*")
        .where(F.col("units").isNotNull() & (F.col("partners") > 0))
    )


TOTALS = ["BAU_TOTAL_UNITS", "TEST_TOTAL_UNITS", "BAU_TOTAL_DOLLARS", "TEST_TOTAL_DOLLARS"]


def mismatch_report(presence: DataFrame, agreement: DataFrame) -> DataFrame:
    """UPCs without a shared description: one row per UPC, side and description.

    Each row has the UPC's totals of both sides. The form is the same at any size: no
    row holds a whole UPC.
    """
    problem = disjoint_upcs(agreement).select(
        "UPC_CODE", F.struct(*TOTALS).alias("__totals"), (F.col("n_bau") + F.col("n_test")).alias("__n")
    )
    found = lookup_by_key(presence, problem, "UPC_CODE", "__totals", "__n")
    return found.where(F.col("__totals").isNotNull()).select(
        "UPC_CODE",
        F.when(F.col("Present In") == ONLY_BAU, "BAU").otherwise("TEST").alias("SIDE"),
        "PRODUCT_DESCRIPTION", "__totals.*",
    )


def store_rows(rows: DataFrame, store: str, store_col: str = "Store") -> DataFrame:
    """Rows of one store, with the store code as a number (bad code: 0)."""
    return rows.where(F.col(f"`{store_col}`") == store).withColumn(
        store_col, coerce_numeric(F.col(f"`{store_col}`"))
    )
