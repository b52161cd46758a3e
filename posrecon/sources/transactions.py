"""Fixed-width header / detail / trailer files, flattened to one row per detail.

Reading state runs along a file: a header line opens a transaction, details take its
fields, a trailer closes it and belongs to every detail since the trailer before.
Here the state is rebuilt per piece of a read block with running windows, and a table with one
row per piece (called block below) carries it across their borders:

* into a block comes the state at the end of the nearest earlier block that has a
  header or trailer line,
* details after a block's last trailer get the first trailer of a later block.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from posrecon.config import as_layout
from posrecon.functions.text import slice_field
from posrecon.shared import stored
from posrecon.sources.lines import (
    BLOCK,
    FILE,
    FILE_ID,
    SEQ,
    VALUE,
    attach_blocks,
    block_table,
    in_pieces,
    one_path_per_id,
    read_lines,
)

_OPEN = "__open"
_DETAIL = "__detail"


def read_transactions(
    spark: SparkSession,
    paths: str | Iterable[str],
    header_prefix: str,
    header_layout,
    detail_layout,
    trailer_prefix: str | None = None,
    trailer_layout=None,
    encoding: str = "cp1252",
    with_file: bool = False,
    with_position: bool = False,
    seen: Observation | None = None,
) -> DataFrame:
    """Details with their header's fields and, given a trailer, its fields.

    A detail field wins over a header field of the same name, a trailer field over
    both. Details before any header, or between a trailer and the next header, are
    dropped. Without ``trailer_prefix`` a trailer line counts as a detail. Details
    after the last trailer have null trailer fields. ``with_position`` keeps the
    columns that order the rows inside a file. ``seen`` counts ``details`` and, of these, the
    dropped ``orphan_details`` on the same pass.
    """
    lines = read_lines(spark, paths, encoding, ordered=True, keep=F.col(VALUE) != "")
    return flatten_transactions(
        lines, header_prefix, header_layout, detail_layout, trailer_prefix, trailer_layout, with_file, with_position, seen
    )


def flatten_transactions(
    lines: DataFrame,
    header_prefix: str,
    header_layout,
    detail_layout,
    trailer_prefix: str | None = None,
    trailer_layout=None,
    with_file: bool = False,
    with_position: bool = False,
    seen: Observation | None = None,
) -> DataFrame:
    """:func:`read_transactions` for ordered lines that are already read (blank ones left out)."""
    headers, details = as_layout(header_layout), as_layout(detail_layout)
    trailers = as_layout(trailer_layout) if trailer_prefix else []
    if not headers:
        raise ValueError("header / detail files need a header layout")
    if not details:
        raise ValueError("header / detail files need a detail layout")

    line = F.col(VALUE)
    is_header = F.startswith(line, F.lit(header_prefix))
    is_trailer = (
        ~is_header & F.startswith(line, F.lit(trailer_prefix)) if trailer_prefix else F.lit(False)
    )
    h = {f.field: f"__h{i}" for i, f in enumerate(headers)}
    d = {f.field: f"__d{i}" for i, f in enumerate(details)}
    t = {f.field: f"__t{i}" for i, f in enumerate(trailers)}

    # Cut the fields before the shuffle, so that only the columns a query asks for
    # are shuffled instead of whole lines.
    parsed = (
        in_pieces(lines).select(
            FILE, FILE_ID, BLOCK, SEQ,
            F.when(is_header, True).when(is_trailer, False).alias(_OPEN),
            (~is_header & ~is_trailer).alias(_DETAIL),
            *[F.when(is_header, slice_field(line, f)).alias(h[f.field]) for f in headers],
            *[
                F.when(~is_header & ~is_trailer, slice_field(line, f)).alias(d[f.field])
                for f in details
            ],
            *[F.when(is_trailer, slice_field(line, f)).alias(t[f.field]) for f in trailers],
        )
    )

    in_order = Window.partitionBy(FILE_ID, BLOCK).orderBy(SEQ)
    backwards = Window.partitionBy(FILE_ID, BLOCK).orderBy(F.desc(SEQ))
    rows = parsed.drop(FILE).select(
        FILE_ID, BLOCK, SEQ, _DETAIL, *d.values(),
        F.last(_OPEN, ignorenulls=True).over(in_order).alias(_OPEN),
        *[F.last(c, ignorenulls=True).over(in_order).alias(c) for c in h.values()],
        *[F.last(c, ignorenulls=True).over(backwards).alias(c) for c in t.values()],
    ).where(_DETAIL)

    rows = attach_blocks(rows, _carried(parsed, list(h.values()), list(t.values())))
    is_open = F.coalesce(F.col(_OPEN), F.col("__in.open"), F.lit(False))
    if seen is not None:
        rows = rows.observe(
            seen, F.count(F.lit(1)).alias("details"), F.count_if(~is_open).alias("orphan_details")
        )
    rows = rows.where(is_open)

    def value(name: str):
        options = []
        if name in t:
            options += [F.col(t[name]), F.col(f"__next.{t[name]}")]
        if name in d:
            options.append(F.col(d[name]))
        elif name in h:
            options += [F.col(h[name]), F.col(f"__in.{h[name]}")]
        return (F.coalesce(*options) if len(options) > 1 else options[0]).alias(name)

    names = list(dict.fromkeys([f.field for f in headers + details + trailers]))
    return rows.select(
        *[value(n) for n in names],
        *([F.col(FILE)] if with_file else []),
        *([F.col(BLOCK)["block"].alias(BLOCK), F.col(SEQ)] if with_position else []),
    )


def transaction_counts(
    spark: SparkSession,
    paths: str | Iterable[str],
    header_prefix: str,
    trailer_prefix: str | None = None,
    encoding: str = "cp1252",
) -> DataFrame:
    """Per file: ``details`` and, of these, ``orphans`` (before any header, or between a trailer and the next header).

    Lines are not shuffled. A block tells where its first and last header or trailer stand, how many details lie before
    the first, and how many follow a trailer inside; those before the first are orphans if the
    blocks above leave no transaction open.
    """
    line = F.col(VALUE)
    is_header = F.startswith(line, F.lit(header_prefix))
    is_trailer = ~is_header & F.startswith(line, F.lit(trailer_prefix)) if trailer_prefix else F.lit(False)
    lines = read_lines(spark, paths, encoding, ordered=True, keep=line != "").select(
        FILE, FILE_ID, BLOCK, SEQ, F.when(is_header, True).when(is_trailer, False).alias(_OPEN)
    )
    # A mark and the place of the next one: details between a trailer and the next mark are the distance of the two.
    marks = stored(lines.where(F.col(_OPEN).isNotNull()))
    blocks = stored(block_table(lines, F.count(F.lit(1)).alias("n"), F.min(SEQ).alias("first")))
    in_block = Window.partitionBy(FILE_ID, BLOCK).orderBy(SEQ)
    placed = marks.withColumn("next", F.lead(SEQ).over(in_block))
    per_block = placed.groupBy(FILE_ID, BLOCK).agg(
        F.min(SEQ).alias("mark"), F.count(F.lit(1)).alias("marks"), F.max_by(_OPEN, SEQ).alias("open"),
        F.max(SEQ).alias("last"),
        F.sum(F.when(~F.col(_OPEN), F.col("next") - F.col(SEQ) - 1)).alias("closed"),
    )
    above = Window.partitionBy(FILE_ID).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    told = one_path_per_id(blocks).join(per_block, [FILE_ID, BLOCK], "left").withColumn(
        "in", F.coalesce(F.last("open", ignorenulls=True).over(above), F.lit(False))
    )
    before = F.coalesce(F.col("mark") - F.col("first"), F.col("n"))
    after = F.when(~F.col("open"), F.col("first") + F.col("n") - 1 - F.col("last"))
    orphans = F.when(~F.col("in"), before).otherwise(0) + F.coalesce("closed", F.lit(0)) + F.coalesce(after, F.lit(0))
    return told.groupBy(FILE).agg(
        F.sum(F.col("n") - F.coalesce("marks", F.lit(0))).alias("details"), F.sum(orphans).alias("orphans")
    )


def _carried(parsed: DataFrame, h: list[str], t: list[str]) -> DataFrame:
    """Per block: the state before its first line and the trailer after its last."""
    state = F.struct(F.col(_OPEN).alias("open"), *h)
    blocks = block_table(
        parsed,
        F.max_by(F.when(F.col(_OPEN).isNotNull(), state), F.when(F.col(_OPEN).isNotNull(), F.col(SEQ)))
        .alias("__state"),
        *(
            [F.min_by(F.when(~F.col(_OPEN), F.struct(*t)), F.when(~F.col(_OPEN), F.col(SEQ))).alias("__first")]
            if t
            else []
        ),
    )
    earlier = Window.partitionBy(FILE_ID).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(FILE_ID).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(
        FILE, FILE_ID, BLOCK,
        F.last("__state", ignorenulls=True).over(earlier).alias("__in"),
        *([F.last("__first", ignorenulls=True).over(later).alias("__next")] if t else []),
    )
