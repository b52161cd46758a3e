"""Raw text lines with a position inside their file.

A text scan keeps line order inside a read block, so a line's place in its file is
``(block start offset, monotonically increasing id)``. Work that depends on order
is keyed by (file, block), never by file: a block is at most one file split, so a
single huge file spreads over as many tasks as it has splits. What one block needs
to know about the blocks before or after it travels in a table with one row per
block.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posrecon.functions.text import decode_bytes
from posrecon.shared import stored

FILE = "source_file"
FILE_ID = "__file_id"
BLOCK = "__block"
SEQ = "__seq"
VALUE = "value"
LINE_NO = "line_no"
#: Lines whose state is worked out together are at most 2 to this power, and of one read block.
PIECE_BITS = 15
#: Rows of a numeric index (about 100 bytes each in memory) that may be sent to every task: the read blocks of
#: 2 PB at 128 MB. Longer ones are joined.
INDEX_ROWS = 16_000_000


def as_paths(paths: str | Iterable[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def file_name(path: Column) -> Column:
    """Base name of a file path as the scan reports it (percent-encoded)."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.try_url_decode(F.replace(base, F.lit("+"), F.lit("%2B")))


def plain_path(path: str) -> str:
    """A reported file path in the form the readers accept: decoded, and with the
    characters of glob patterns escaped."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(path))


def read_lines(
    spark: SparkSession,
    paths: str | Iterable[str],
    encoding: str = "cp1252",
    ordered: bool = False,
    keep: Column | None = None,
    with_file: bool = False,
) -> DataFrame:
    """Decoded lines; ``with_file`` adds their file, ``ordered`` that and the position.

    ``keep`` filters the undecoded ``value``. A filter on the decoded text would be
    pushed below the decoding and repeat it.
    """
    cols = [decode_bytes(F.col("value").cast("binary"), encoding).alias(VALUE)]
    if ordered or with_file:
        cols.append(F.col("_metadata.file_path").alias(FILE))
    if ordered:
        cols += [
            F.xxhash64("_metadata.file_path").alias(FILE_ID),
            F.col("_metadata.file_block_start").alias(BLOCK),
            F.monotonically_increasing_id().alias(SEQ),
        ]
    raw = spark.read.text(as_paths(paths))
    return (raw if keep is None else raw.where(keep)).select(*cols)


def starts_with(prefix: str) -> Column | None:
    """Test an undecoded line for a prefix; None where that needs the decoded text."""
    return F.startswith(F.col(VALUE), F.lit(prefix)) if prefix.isascii() else None


def block_table(lines: DataFrame, *aggregates: Column) -> DataFrame:
    """One row per (file, block) with the given aggregates."""
    return lines.groupBy(FILE, FILE_ID, BLOCK).agg(*aggregates)


def in_pieces(lines: DataFrame) -> DataFrame:
    """Ordered lines with the place of a piece of a read block, instead of the block, as ``BLOCK``.

    What is keyed by (file, block) then takes the pieces of a block to many tasks, and no task sorts a whole block;
    pieces are in order as blocks are.
    """
    return lines.withColumn(BLOCK, F.struct(F.col(BLOCK).alias("block"), F.shiftright(SEQ, PIECE_BITS).alias("piece")))


def one_path_per_id(table: DataFrame) -> DataFrame:
    """Stop the job if two paths share a file id, so that ids are never trusted silently."""
    same_id = Window.partitionBy(FILE_ID)
    return table.withColumn(
        FILE,
        F.when(F.min(FILE).over(same_id) == F.max(FILE).over(same_id), F.col(FILE)).otherwise(
            F.raise_error(F.lit("two input paths share one file id"))
        ),
    )


def attach_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Give every row the columns of its block.

    Rows already partitioned by (file id, block) are not moved again. The job stops if a
    row's block is unknown.
    """
    joined = rows.join(one_path_per_id(blocks), [FILE_ID, BLOCK], "left")
    return joined.where(
        F.when(F.col(FILE).isNotNull(), True).otherwise(
            F.raise_error(F.lit("input split layout changed while reading")).cast("boolean")
        )
    )


def with_index(rows: DataFrame, index: DataFrame, keys: list[str], n_rows: int) -> DataFrame:
    """Left-join a stored index of numbers, one row per file or read block, without moving the rows."""
    return rows.join(F.broadcast(index) if n_rows <= INDEX_ROWS else index, keys, "left")


def number_lines(lines: DataFrame) -> DataFrame:
    """Add the 0-based line number inside the file to ``ordered`` lines.

    Positions count up by one inside a block, so a number is the lines before the block plus
    the distance from its first position. Lines are neither shuffled nor sorted: the index with
    one row of numbers per block is counted, and sent to every task.
    """
    before = Window.partitionBy(FILE_ID).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    counted = stored(block_table(lines, F.count(F.lit(1)).alias("__n"), F.min(SEQ).alias("__first")))
    offset = F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
    index = one_path_per_id(counted).where(F.col(FILE).isNotNull()).select(FILE_ID, BLOCK, "__n", "__first", offset)
    rows = with_index(lines, index, [FILE_ID, BLOCK], counted.count())
    place = F.col(SEQ) - F.col("__first")
    number = F.when((place >= 0) & (place < F.col("__n")), F.col("__offset") + place).otherwise(
        F.raise_error(F.lit("input split layout changed while reading")).cast("long")
    )
    return rows.withColumn(LINE_NO, number).drop("__offset", "__first", "__n")


def skip_lines(lines: DataFrame, start_line: int) -> DataFrame:
    """Drop the first ``start_line`` physical lines of every file."""
    if start_line <= 0:
        return lines
    return number_lines(lines).where(F.col(LINE_NO) >= start_line)


def head_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first ``n`` lines of every file, numbered from 0.

    The first ranking keeps ``n`` lines per block before anything is shuffled; the
    second ranks those few per file.
    """
    in_block = F.row_number().over(Window.partitionBy(FILE_ID, BLOCK).orderBy(SEQ))
    in_file = F.row_number().over(Window.partitionBy(FILE_ID, FILE).orderBy(BLOCK, SEQ))
    return (
        lines.withColumn("__r", in_block)
        .where(F.col("__r") <= n)
        .withColumn("__r", in_file)
        .where(F.col("__r") <= n)
        .withColumn(LINE_NO, F.col("__r") - 1)
        .drop("__r")
    )
