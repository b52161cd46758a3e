"""Records of delimited files whose quoted cells may contain line breaks.

A line is a function of two states: does it begin inside a quoted cell, and does its end lie inside one? There are
four such functions; a line without quotes keeps the state, and most others fix it whatever came before.
The state before a line is therefore the value of the nearest line above that fixes it, turned over by
each line since that swaps the states. Inside a piece of a read block (a block below) that is a running window; over
block borders a table with one row per block carries the state and the place where the open record began. Files
split like any others, and the lines of a record that crosses a border meet at its first line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posrecon.functions.text import literal_pattern
from posrecon.shared import stored
from posrecon.sources.lines import BLOCK, FILE, FILE_ID, LINE_NO, SEQ, VALUE, attach_blocks, block_table, in_pieces


def _patterns(delimiter: str) -> tuple[str, str, str]:
    """A whole quoted cell at its place, the rest of one that began on an earlier line, the start of an open one.

    A quote opens a cell at its start only. Inside, a doubled quote is a quote, and one before a delimiter or
    the end of the line closes the cell. Repeats give nothing back, so they take linear time and no stack.
    """
    d = literal_pattern(delimiter)
    after = rf"(?:{d}|\z)"
    rest = rf'[^"]*+(?:(?:""|"(?!"|{after}))[^"]*+)*+"(?={after})'
    return rf'(\A|{d})"{rest}', rf"\A{rest}", rf'(?:\A|{d})"'


def ends_inside(line: Column, delimiter: str) -> tuple[Column, Column]:
    """Whether the line ends inside a quoted cell, if it began outside and if it began inside of one."""
    whole, rest, opening = _patterns(delimiter)
    is_open = lambda text: F.regexp_replace(text, whole, "$1").rlike(opening)
    quotes = F.contains(line, F.lit('"'))
    from_outside = quotes & is_open(line)
    from_inside = ~quotes | F.when(line.rlike(rest), is_open(F.regexp_replace(line, rest, ""))).otherwise(True)
    return from_outside, from_inside


def _with_states(lines: DataFrame) -> DataFrame:
    """Add ``__turns`` (swaps above, in the block) and ``__fixed`` (value and turns of the nearest line above that
    fixes the state)."""
    above = Window.partitionBy(FILE_ID, BLOCK).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, -1)
    out, inside = F.col("__out"), F.col("__in")
    swaps = F.when(out & ~inside, 1).otherwise(0)
    turned = lines.withColumn("__turns", F.coalesce(F.sum(swaps).over(above), F.lit(0)))
    fixing = F.when(out == inside, F.struct(out.alias("v"), F.col("__turns").alias("t")))
    return turned.withColumn("__fixed", F.last(fixing, ignorenulls=True).over(above))


def _before(state: Column) -> Column:
    """The state before a line, given that before its block."""
    fixed = F.col("__fixed")
    odd = (F.col("__turns") - F.coalesce(fixed["t"], F.lit(0))) % 2 == 1
    return F.coalesce(fixed["v"], state) != odd


def _after(before: Column) -> Column:
    return F.when(before, F.col("__in")).otherwise(F.col("__out"))


def _carried(lines: DataFrame) -> DataFrame:
    """Per block: the state before its first line, and the line where the record open there began."""
    shown = _with_states(lines.select(FILE, FILE_ID, BLOCK, SEQ, "__out", "__in"))
    ends, begins = [], []
    for k, state in enumerate((F.lit(False), F.lit(True))):
        before = _before(state)
        ends.append(F.max_by(_after(before), SEQ).alias(f"__end{k}"))
        begins.append(F.max(F.when(~before & F.col("__out"), F.col(SEQ))).alias(f"__begin{k}"))
    blocks = stored(block_table(shown, *ends, *begins))
    w = Window.partitionBy(FILE_ID).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    out, inside = F.col("__end0"), F.col("__end1")
    turned = blocks.withColumn("__t", F.coalesce(F.sum(F.when(out & ~inside, 1).otherwise(0)).over(w), F.lit(0)))
    last = F.last(F.when(out == inside, F.struct(out.alias("v"), F.col("__t").alias("t"))), ignorenulls=True).over(w)
    known = turned.withColumn("__last", last)
    odd = (F.col("__t") - F.coalesce(F.col("__last.t"), F.lit(0))) % 2 == 1
    known = known.withColumn("__state", F.coalesce(F.col("__last.v"), F.lit(False)) != odd)
    begin = F.when(F.col("__state"), F.col("__begin1")).otherwise(F.col("__begin0"))
    at = F.when(begin.isNotNull(), F.struct(F.col(BLOCK).alias("block"), begin.alias("seq")))
    return known.select(FILE, FILE_ID, BLOCK, "__state", F.last(at, ignorenulls=True).over(w).alias("__from"))


def quoted_records(lines: DataFrame, delimiter: str) -> DataFrame:
    """Lines joined to records; each has the position (and number) of its first line.

    ``lines`` are ordered lines. A quote that is never closed takes the rest of its file.
    """
    out, inside = ends_inside(F.col(VALUE), delimiter)
    marked = in_pieces(lines).withColumns({"__out": out, "__in": inside})
    rows = attach_blocks(_with_states(marked.drop(FILE)), _carried(marked))
    before = _before(F.col("__state"))
    rows = rows.withColumns({"__before": before, "__after": _after(before)})
    upto = Window.partitionBy(FILE_ID, BLOCK).orderBy(SEQ)
    begun = F.last(F.when(~F.col("__before"), F.col(SEQ)), ignorenulls=True).over(upto)
    rows = rows.withColumn("__begun", begun)
    own = [c for c in (FILE, FILE_ID, BLOCK, SEQ, LINE_NO, VALUE) if c in lines.columns]
    alone = rows.where(~F.col("__before") & ~F.col("__after")).select(*own)
    first = lambda c: F.col("__lines")[0][c].alias(c)
    several = (
        rows.where(F.col("__before") | F.col("__after"))
        .withColumn("__at", F.when(F.col("__begun").isNull(), F.col("__from")).otherwise(F.struct(F.col(BLOCK).alias("block"), F.col("__begun").alias("seq"))))
        .groupBy(FILE_ID, "__at")
        .agg(F.sort_array(F.collect_list(F.struct(BLOCK, SEQ, *[c for c in own if c not in (FILE_ID, BLOCK, SEQ)]))).alias("__lines"))
        .select(
            *[F.col(c) if c == FILE_ID else first(c) for c in own if c != VALUE],
            F.array_join(F.transform("__lines", lambda x: x[VALUE]), "\n").alias(VALUE),
        )
    )
    return alone.unionByName(several).withColumn(BLOCK, F.col(BLOCK)["block"])
