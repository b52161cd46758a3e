"""Building blocks that keep hot keys and large groups off single tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posrecon.shared import stored

HOT_KEYS = 1000
SPREAD = 1 << 20


def lookup_by_key(
    rows: DataFrame, table: DataFrame, key: str, value: str, weight: str, hot_keys: int = HOT_KEYS
) -> DataFrame:
    """Left-join one ``value`` per ``key`` onto ``rows``.

    ``table`` has unique keys and the row count of each in ``weight``. Its
    ``hot_keys`` heaviest entries (a fixed number) are broadcast; the other rows
    join by shuffle, where no key can hold more than 1/hot_keys of them. Rows
    already served, and rows with a null key, spread evenly over the shuffle.
    """
    hot = table.orderBy(F.desc(weight), key).limit(hot_keys).select(
        F.col(f"`{key}`").alias("__hot_key"), F.col(f"`{value}`").alias("__hot_value")
    )
    cold = table.select(
        F.col(f"`{key}`").alias("__cold_key"), F.lit(0).alias("__spread"),
        F.col(f"`{value}`").alias("__cold_value"),
    )
    own = F.col(f"`{key}`")
    open_key = own.isNotNull() & F.col("__hot_key").isNull()
    columns = [F.col(f"`{c}`") for c in rows.columns]
    spread = F.pmod(F.xxhash64(*columns), F.lit(SPREAD)).cast("int")
    return (
        rows.join(F.broadcast(hot), own == F.col("__hot_key"), "left")
        .withColumn("__cold_key", F.when(open_key, own))
        .withColumn("__spread", F.when(open_key, F.lit(0)).otherwise(spread))
        .join(cold, ["__cold_key", "__spread"], "left")
        .select(*columns, F.coalesce("__hot_value", "__cold_value").alias(value))
    )


def rows_before(table: DataFrame, key: str, weight: str, ascending: bool) -> DataFrame:
    """Add ``__before``: the total weight of the keys ordered before each key.

    The table is dealt out by ranges of the key, as many as the shuffle has parts. Ranges
    are summed, one row per range runs through one window, and each range continues
    from its start with a window of its own.
    """
    k = F.col(f"`{key}`")
    ranged = stored(table.repartitionByRange(k).withColumn("__range", F.spark_partition_id()))
    direction = (lambda c: c.asc()) if ascending else (lambda c: c.desc())
    up_to_now = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__range").agg(F.sum(weight).alias("__w")).select(
        "__range",
        F.sum("__w").over(up_to_now(Window.orderBy(direction(F.col("__range"))))).alias("__start"),
    )
    inside = F.sum(weight).over(up_to_now(Window.partitionBy("__range").orderBy(direction(k))))
    return (
        ranged.withColumn("__inside", inside)
        .join(F.broadcast(starts), "__range", "left")  # one row per part of the shuffle
        .withColumn("__before", F.coalesce("__start", F.lit(0)) + F.coalesce("__inside", F.lit(0)))
        .drop("__range", "__inside", "__start")
    )
