"""Expressions and table helpers that the text operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from posrecon.shared import scratch_dir

#: The characters between words.
SPACES = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _UPPER.lower())


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null or blank text."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    empty = F.array().cast("array<string>")
    return let(inner, lambda t: F.when(t == "", empty).otherwise(F.split(t, "[ \\t-\\r]+")))


def saved(df: DataFrame) -> DataFrame:
    """Write a table once below the shared folder and read it back.

    The plan ends there: a lost executor costs a re-read, not a new computation.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash_place(*keys: str) -> Column:
    """A place in [0, 2^63) drawn from the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 1)


def smallest_hashes(rows: DataFrame, most: int, key: str) -> DataFrame:
    """The ``most`` rows with the smallest hash of ``key``, or all if there are no more.

    A first cut at twice the share that is wanted leaves few rows to sort; the limit holds by construction.
    """
    n = rows.count()
    if n <= most:
        return rows
    place = hash_place(key)
    cut = min((1 << 63) - 1, (1 << 63) * 2 * (most + 50) // n)
    return rows.where(place <= cut).orderBy(place, key).limit(most)


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / per_part))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
