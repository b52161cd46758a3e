"""Item audit of two sides' row-level output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posrecon.operators.audit import (
    common_upcs,
    description_mismatch,
    differences_of,
    disjoint_upcs,
    key_counts,
    mismatch_report,
    presence_of_rows,
    upc_agreement,
)


def item_audit(bau: DataFrame, test: DataFrame, exact: bool | int = False) -> dict[str, DataFrame]:
    """All audit frames; one aggregation sums both sides, and its keys are cached.

    Call ``presence.unpersist()`` on the ``presence`` frame when done.
    """
    presence = presence_of_rows(bau, test, exact).persist()
    agreement = upc_agreement(presence)
    return {
        "comparison": differences_of(presence),
        "presence": presence,
        "key_counts": key_counts(presence),
        "common_upcs": common_upcs(agreement),
        "mismatch_count": agreement.agg(
            F.coalesce(F.sum("mismatched_pairs"), F.lit(0)).alias("mismatched_pairs")
        ),
        "description_mismatch": description_mismatch(presence, agreement),
        "disjoint_upcs": disjoint_upcs(agreement),
        "mismatch_report": mismatch_report(presence, agreement),
    }
