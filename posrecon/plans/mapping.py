"""Which column plays which role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posrecon.functions.text import strip

# Names that retailers use for each role.
COLUMN_SYNONYMS = {
    "Store": [
        "store", "store number", "store_id", "store id", "store code", "store_code",
        "store_number", "store num", "location", "location code",
    ],
    "UPC": [
        "upc", "upc_code", "upc code", "item upc", "item_upc", "upc number", "upc_number",
        "barcode", "upc12", "gtin", "ean", "product code",
    ],
    "Description": [
        "description", "desc", "item description", "item_description", "product description",
        "product_description", "product name", "item name", "name", "description of goods",
    ],
    "Units": [
        "units", "qty", "quantity", "sold", "units sold", "units_sold", "quantity sold",
        "sales quantity", "qty sold", "unit sold", "sale quantity",
    ],
    "Price": [
        "price", "total price", "total_price", "sales", "amount", "dollars", "total dollars",
        "total_dollars", "revenue", "total revenue", "selling price", "sales amount",
        "sale price", "price sold",
    ],
}

# Configuration field of each role.
ROLE_FIELDS = {
    "Store": "store_col", "UPC": "upc_col", "Description": "desc_col",
    "Units": "units_col", "Price": "price_col",
}


def best_column_index(columns: Column, target: str, synonyms: list[str]) -> Column:
    """0-based index of the likeliest column for a role in an array of names.

    In this order: named exactly like the role, exactly like a synonym (earlier
    synonyms first), the first column that contains a synonym or is contained in
    one, the same with the role name, else the first column.
    """
    names = F.transform(columns, lambda c: F.lower(strip(c)))
    role = target.lower()
    words = F.array(*[F.lit(s) for s in synonyms])

    def position(flags: Column, wanted) -> Column:
        return F.nullif(F.array_position(flags, wanted), F.lit(0))

    related = F.transform(
        names, lambda c: F.exists(words, lambda s: F.contains(c, s) | F.contains(s, c))
    )
    like_role = F.transform(
        names, lambda c: F.contains(c, F.lit(role)) | F.contains(F.lit(role), c)
    )
    return (
        F.coalesce(
            position(names, role),
            *[position(names, s) for s in synonyms],
            position(related, True),
            position(like_role, True),
            F.lit(1),
        )
        - 1
    ).cast("int")


def suggest_mapping(df: DataFrame, columns: str = "columns") -> DataFrame:
    """Add ``store_col`` ... ``price_col``, chosen from an array column of names."""
    return df.withColumns(
        {
            ROLE_FIELDS[role]: F.get(columns, best_column_index(F.col(columns), role, synonyms))
            for role, synonyms in COLUMN_SYNONYMS.items()
        }
    )


def mapping_errors() -> Column:
    """Messages about the five role columns: unset ones, then columns used twice."""
    roles = list(ROLE_FIELDS.items())
    unset = [
        # The messages here and below.
        F.when(F.coalesce(F.col(c), F.lit("")) == "", f"{role} column is not selected.")
        for role, c in roles
    ]
    twice = []
    for j, (role, c) in enumerate(roles):
        message = F.lit(None).cast("string")
        for earlier, e in roles[:j]:
            text = F.format_string(
                f"Duplicate column: '%s' is selected for both '{earlier}' and '{role}'. "
                "Each column must be unique.",
                F.col(c),
            )
            message = F.when((F.col(c) != "") & (F.col(c) == F.col(e)), text).otherwise(message)
        twice.append(message)
    return F.array_compact(F.array(*unset, *twice))


def check_mapping(df: DataFrame) -> DataFrame:
    """Add ``errors`` to rows that hold the five role columns."""
    return df.withColumn("errors", mapping_errors())
