"""Profile of a landing folder: one row per file with its likely format.

All lines of a file decide. A first scan counts what the lines look like per (file, read
block, prefix or record letter), a second one takes the first line of each file, which has the names,
and a third one counts the kinds of values per (file, column) once the delimiter is known. Only counts
and first lines are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posrecon.config import DEFAULT_RECORD_TYPES, FormatConfig
from posrecon.functions.text import delimiter_count, is_ascii, redecode_latin1, split_literal, strip
from posrecon.plans.mapping import suggest_mapping
from posrecon.shared import stored
from posrecon.sources.lines import (
    BLOCK, FILE, FILE_ID, SEQ, VALUE, file_name, one_path_per_id, read_lines, with_index,
)

# Least shares of the lines that are not blank, and the delimiters tried, in order of
# preference.
FORM_SHARE = 0.5
HEADER_SHARE = 0.1
PREFIX_SHARE = 0.05
DELIMITERS = [",", "|", "\t", ";"]

_TEXT = "__text"
_PREFIX = r"^(\p{L}{2,5})\p{Nd}"
_RECORD = r"^(\p{L})[,|\t;]"


def _lines(spark: SparkSession, paths) -> DataFrame:
    lines = read_lines(spark, paths, "latin-1", ordered=True)
    return lines.withColumn(_TEXT, redecode_latin1(F.col(VALUE), "cp1252"))


def _counts(lines: DataFrame) -> DataFrame:
    """Counts per (file, block, prefix, record letter, whether the line starts with it).

    All results are numbers and flags, so the groups are hashed and no line is sorted.
    """
    text, bare = F.col(_TEXT), F.col("__bare")
    found = lambda pattern: F.nullif(F.regexp_extract(bare, pattern, 1), F.lit(""))
    ascii_line = is_ascii(F.col(VALUE))
    valid = F.is_valid_utf8(F.encode(F.col(VALUE), "ISO-8859-1").cast("string"))
    quoted = F.contains(text, F.lit('"'))
    counted = {f"__d{i}": F.when(quoted, delimiter_count(text, d)).otherwise(_times(text, d)) for i, d in enumerate(DELIMITERS)}
    keyed = lines.withColumns({"__bare": strip(text), **counted}).withColumns({"prefix": found(_PREFIX), "letter": found(_RECORD)}).withColumn(
        "flush", F.coalesce("prefix", "letter").isNotNull() & text.rlike(r"^\p{L}")
    )
    marks = [F.sum(c).alias(f"s{i}") for i, c in enumerate(counted)]
    lines_with = [F.count_if(F.col(c) > 0).alias(f"l{i}") for i, c in enumerate(counted)]
    return keyed.groupBy(FILE, FILE_ID, BLOCK, "prefix", "letter", "flush").agg(
        *marks,
        *lines_with,
        F.count_if(bare != "").alias("n"),
        F.count_if(F.endswith(bare, F.lit("\\"))).alias("continued"),
        F.count_if(F.col("prefix").isNull() & bare.rlike(r"^\p{Nd}")).alias("digit_led"),
        F.bool_and(ascii_line).alias("ascii"),
        F.bool_and(ascii_line | valid).alias("utf8"),
        F.min(SEQ).alias("first"),
    )


def _times(text: Column, delimiter: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(delimiter), F.lit("")))


def _first_lines(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """File and the text of its first line, found by its place."""
    places = counts.groupBy(FILE, FILE_ID).agg(F.min(F.struct(F.col(BLOCK), F.col("first").alias(SEQ))).alias("p"))
    places = stored(places.select(FILE_ID, "p.*", F.lit(True).alias("__is_first")))
    placed = with_index(lines.select(FILE, FILE_ID, BLOCK, SEQ, _TEXT), places, [FILE_ID, BLOCK, SEQ], places.count())
    return placed.where("__is_first").select(FILE, F.col(_TEXT).alias("names_line"))


def _file_format(counts: DataFrame, first_lines: DataFrame) -> DataFrame:
    sums = [f"{c}{i}" for c in "sl" for i in range(len(DELIMITERS))]
    facts = counts.groupBy(FILE).agg(
        *(F.sum(c).alias(c) for c in (*sums, "n", "continued", "digit_led")),
        F.sum(F.when(F.col("prefix").isNotNull(), F.col("n")).otherwise(0)).alias("prefixed"),
        F.sum(F.when(F.col("letter").isNotNull(), F.col("n")).otherwise(0)).alias("lettered"),
        F.size(F.collect_set("letter")).alias("letters"),
        F.sort_array(F.collect_set(F.when(F.col("flush"), F.col("letter")))).alias("record_types"),
        F.bool_and("ascii").alias("ascii"),
        F.bool_and("utf8").alias("utf8"),
    ).join(first_lines, FILE).withColumn("first_line", strip(F.col("names_line")))
    # The longest prefix of those that many lines have or the first line has.
    per_prefix = counts.filter(F.col("flush") & F.col("prefix").isNotNull()).groupBy(FILE, "prefix").agg(F.sum("n").alias("k"))
    lead = F.regexp_extract("names_line", _PREFIX, 1)
    often = per_prefix.join(facts.select(FILE, "n", lead.alias("lead")), FILE).filter(
        (F.col("k") >= PREFIX_SHARE * F.col("n")) | (F.col("prefix") == F.col("lead"))
    )
    longest = often.groupBy(FILE).agg(F.min(F.struct((-F.length("prefix")).alias("n"), F.col("prefix").alias("p")))["p"].alias("longest"))
    facts = facts.join(longest, FILE, "left")
    least = lambda c, share: F.col(c) >= share * F.col("n")
    scores = [F.when(least(f"l{i}", FORM_SHARE), F.col(f"s{i}")).otherwise(0) for i in range(len(DELIMITERS))]
    facts = facts.withColumns({f"s{i}": score for i, score in enumerate(scores)})
    best = F.greatest(*[F.col(f"s{i}") for i in range(len(DELIMITERS))])
    found = None
    for i, d in enumerate(DELIMITERS):
        hit = (F.col(f"s{i}") == best) & (best > 0)
        found = F.when(hit, d) if found is None else found.when(hit, d)
    headed = (F.regexp_extract("first_line", _PREFIX, 1) != "") | least("prefixed", HEADER_SHARE)
    multi = (
        ((F.col("letters") >= 2) & least("lettered", FORM_SHARE))
        | ((F.col("continued") >= 5) & least("continued", FORM_SHARE))
        | (
            (F.col("prefixed") >= 1) & (F.col("digit_led") >= 2) & headed
            & (F.col("prefixed") + F.col("digit_led") >= FORM_SHARE * F.col("n"))
        )
    )
    is_multi = F.col("file_type") == "multiline"
    no_prefix = is_multi & F.col("longest").isNull()
    cells = F.split("first_line", F.concat(F.lit("\\Q"), F.coalesce("found", F.lit(",")), F.lit("\\E")), -1)
    with_letter = F.filter(cells, lambda c: c.rlike(r"\p{L}"))
    return (
        facts.withColumn("found", found)
        .withColumn(
            "file_type",
            F.when(F.lower(FILE).rlike(r"\.xlsx?$"), "excel")
            .when(multi, "multiline")
            .when(F.col("found").isNotNull(), "delimited")
            .otherwise("fixed"),
        )
        .select(
            FILE,
            file_name(F.col(FILE)).alias("filename"),
            "file_type",
            F.when(is_multi, "|").when(F.col("file_type") == "delimited", F.col("found")).alias("delimiter"),
            F.when(F.col("ascii"), "cp1252").when(F.col("utf8"), "utf-8").otherwise("cp1252").alias("encoding"),
            (
                ~is_multi
                & (F.coalesce("first_line", F.lit("")) != "")
                & (F.size(with_letter) * 2 >= F.size(cells))
            ).alias("has_header"),
            F.when(is_multi, F.col("longest")).alias("header_prefix"),
            F.when(
                no_prefix,
                F.when(F.size("record_types") > 0, F.col("record_types")).otherwise(
                    F.array(*[F.lit(t) for t in DEFAULT_RECORD_TYPES])
                ),
            ).alias("record_types"),
            "names_line",
        )
    )


def _cells(line: Column, delimiter: Column) -> Column:
    """Cells of a delimited line; delimiters inside double quotes do not split."""
    outside = F.concat(F.lit("\\Q"), delimiter, F.lit('\\E(?=(?:[^"]*"[^"]*")*[^"]*$)'))
    return F.transform(
        F.split(line, outside, -1),
        lambda c: F.when(
            c.rlike('^".*"$'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))
        ).otherwise(c),
    )


_FORMAT = [
    FILE, "filename", "file_type", "delimiter", "encoding", "has_header", "header_prefix",
    "record_types",
]


def _line_cells(text: Column) -> Column:
    """Cells of a line of a delimited or record file, else null."""
    # Record types found by profiling are single letters.
    after = F.substr(text, F.lit(2))
    body = F.when(
        F.exists("record_types", lambda t: F.startswith(text, t)),
        F.when(F.startswith(after, F.lit("|")), F.substr(after, F.lit(2))).otherwise(after),
    )
    plain = F.lit(None).cast("array<string>")
    for d in DELIMITERS:
        plain = F.when(F.col("delimiter") == d, split_literal(text, d)).otherwise(plain)
    cells = F.when(F.contains(text, F.lit('"')), _cells(text, F.col("delimiter"))).otherwise(plain)
    return F.when((F.col("file_type") == "delimited") & (text != ""), cells).when(
        (F.col("file_type") == "multiline") & (body != ""), split_literal(body, "|")
    )


# What a cell holds, and the number of neighbouring cells counted together.
_EMPTY, _INT, _NUMBER, _BOOL, _OTHER = range(5)
_NEAR = 5


def _kind(v: Column) -> Column:
    is_bool = F.length(v).between(4, 6) & v.rlike(r"(?i)^(true|false)$")
    return (
        F.when(F.coalesce(v, F.lit("")) == "", _EMPTY)
        .when(v.rlike(r"^\s*-?\d+$"), _INT)
        .when(v.rlike(r"^[-+]?(\d*\.\d+([eE][-+]?\d+)?|\d+[eE][-+]?\d+|\d+\.|\d+)$"), _NUMBER)
        .when(is_bool, _BOOL)
        .otherwise(_OTHER)
    )


def _with_columns(lines: DataFrame, files: DataFrame, formats: DataFrame) -> DataFrame:
    """Add column names and the types of all values (delimited and record files).

    The line with the names is counted with the others and then taken off.
    """
    files = one_path_per_id(files)
    known = formats.join(files, FILE).select(FILE_ID, FILE, "file_type", "delimiter", "record_types", "names_line")
    placed = with_index(
        lines.select(FILE_ID, _TEXT), known.select(FILE_ID, "file_type", "delimiter", "record_types"), [FILE_ID], files.count()
    )
    delimited = F.col("file_type") == "delimited"
    # Lines are counted by the kinds of neighbouring cells, a few groups per file, before anything is a row per cell.
    # Exploding an array of one has each line cut once; a plain column would be worked out again wherever it is used.
    found = F.transform(_line_cells(F.col(_TEXT)), lambda v: F.when(delimited, _kind(v)).otherwise(_EMPTY))
    kinds = placed.select(FILE_ID, F.explode(F.array(found)).alias("kinds"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("kinds") - 1) / _NEAR).cast("int")), lambda i: F.slice("kinds", i * _NEAR + 1, _NEAR))
    counted = kinds.where(F.size("kinds") > 0).select(FILE_ID, F.posexplode(pieces).alias("piece", "kinds")).groupBy(FILE_ID, "piece", "kinds").agg(
        F.count(F.lit(1)).alias("times")
    )
    every = counted.select(FILE_ID, "piece", "times", F.posexplode("kinds").alias("pos", "of")).select(
        FILE_ID, (F.col("piece") * _NEAR + F.col("pos")).alias("pos"), "of", "times", F.lit(None).cast("string").alias("name")
    )
    names = known.filter(delimited).select(FILE_ID, F.posexplode(_line_cells(F.col("names_line"))).alias("pos", "name")).select(
        FILE_ID, "pos", _kind(F.col("name")).alias("of"), F.lit(-1).cast("long").alias("times"), "name"
    )
    times = lambda c: F.sum(F.when(c, F.col("times")).otherwise(0))
    of = F.col("of")
    per_column = every.unionByName(names).groupBy(FILE_ID, "pos").agg(
        F.max("name").alias("name"),
        times(of != _EMPTY).alias("k"),
        times(of == _INT).alias("ints"),
        times((of == _INT) | (of == _NUMBER)).alias("numbers"),
        times(of == _BOOL).alias("booleans"),
    ).join(known.select(FILE_ID, FILE, "file_type"), FILE_ID)
    kind = (
        F.when(~delimited | (F.col("k") == 0), "String")
        .when(F.col("ints") == F.col("k"), "Int64")
        .when(F.col("numbers") == F.col("k"), "Float64")
        .when(F.col("booleans") == F.col("k"), "Boolean")
        .otherwise("String")
    )
    name = F.when(delimited, F.col("name")).otherwise(
        F.concat(F.lit("Column_"), F.col("pos").cast("string"))
    )
    column = F.when(name.isNotNull(), F.struct("pos", name.alias("name"), kind.alias("kind")))
    columns = per_column.groupBy(FILE).agg(F.array_sort(F.collect_list(column)).alias("c"))
    return formats.join(columns, FILE, "left").select(
        *_FORMAT,
        F.when(F.size("c") > 0, F.col("c.name")).alias("columns"),
        F.when(F.size("c") > 0, F.col("c.kind")).alias("data_types"),
    )


def profile_files(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """Detected format, encoding, columns, types and suggested mapping per file."""
    lines = _lines(spark, paths)
    counts = stored(_counts(lines))
    formats = stored(_file_format(counts, stored(_first_lines(lines, counts))))
    files = counts.select(FILE, FILE_ID).distinct()
    return suggest_mapping(_with_columns(lines, files, formats), "columns")


def config_from_profile(row) -> FormatConfig:
    """A configuration from one profile row, to be checked and completed by a person."""
    columns = list(row["columns"] or []) or None
    return FormatConfig(
        file_type=row["file_type"],
        encoding=row["encoding"],
        has_header=row["has_header"],
        delimiter=row["delimiter"],
        header_prefix=row["header_prefix"],
        ml_record_types=list(row["record_types"] or []) or None,
        schema=columns,
        detected_columns=columns,
        detected_data_types=dict(zip(columns, row["data_types"])) if columns else None,
        **{c: row[c] for c in ("store_col", "upc_col", "desc_col", "units_col", "price_col")},
    )
