"""Text expressions: trimming, positional slices, layout types, decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as white space when a field is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Code page 1252 for the bytes 0x80-0x9F. Its five unassigned bytes
# come last in FROM and have no partner in TO, so translate() drops them.
_CP1252_FROM = (
    "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e"
    "\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
    "\x81\x8d\x8f\x90\x9d"
)
_CP1252_TO = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def strip(c: Column) -> Column:
    """Remove white space at both ends.

    In printable ASCII the only white space is the blank, which ``trim`` removes
    faster; other texts are trimmed with the full list.
    """
    return F.when(c.rlike("[^ -~]"), F.btrim(c, F.lit(WHITESPACE))).otherwise(F.trim(c))


def typed(c: Column, kind: str) -> Column:
    """Apply a layout type to an already stripped field.

    ``numeric`` drops leading zeros (nothing left -> ``"0"``); ``date`` turns a
    six-character YYMMDD into ``20YY-MM-DD``; anything else passes unchanged.
    """
    if kind == "numeric":
        return F.coalesce(F.nullif(F.ltrim(c, F.lit("0")), F.lit("")), F.lit("0"))
    if kind == "date":
        dashed = F.concat(
            F.lit("20"), F.substring(c, 1, 2), F.lit("-"),
            F.substring(c, 3, 2), F.lit("-"), F.substring(c, 5, 2),
        )
        return F.when(F.length(c) == 6, dashed).otherwise(c)
    return c


def slice_field(line: Column, field, apply_type: bool = True) -> Column:
    """One layout field of a line: cut, strip, type. Short lines give shorter fields."""
    raw = strip(F.substring(line, field.start + 1, field.length))
    return typed(raw, field.type) if apply_type else raw


def literal_pattern(text: str) -> str:
    """Regular expression that matches ``text`` literally.

    One punctuation character is escaped with a backslash, the form Java's
    ``String.split`` handles without compiling a pattern.
    """
    if len(text) == 1:
        return text if text.isalnum() else "\\" + text
    return "\\Q" + text + "\\E"


def split_literal(c: Column, delimiter: str) -> Column:
    return F.split(c, literal_pattern(delimiter), -1)


def delimiter_count(line: Column, delimiter: str) -> Column:
    """Occurrences of ``delimiter`` outside double quotes (an open quote runs to the end)."""
    bare = F.regexp_replace(line, '"[^"]*("|$)', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit("")))


def is_ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def latin1_as_cp1252(c: Column) -> Column:
    """Turn text decoded as ISO-8859-1 into code page 1252 (they differ in 0x80-0x9F)."""
    return F.when(is_ascii(c), c).otherwise(
        F.translate(c, _CP1252_FROM, _CP1252_TO)
    )


def decode_bytes(raw: Column, encoding: str) -> Column:
    """Decode a binary column; undecodable bytes never fail the job.

    ``utf-8`` replaces bad bytes, ``cp1252`` drops its unassigned bytes and
    ``auto`` takes UTF-8 where the bytes are valid UTF-8 and cp1252 elsewhere.
    """
    enc = normal_encoding(encoding)
    if enc == "utf-8":
        return F.make_valid_utf8(raw.cast("string"))
    latin1 = F.decode(raw, "ISO-8859-1")
    if enc == "latin-1":
        return latin1
    if enc == "cp1252":
        return latin1_as_cp1252(latin1)
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(latin1_as_cp1252(latin1))


def redecode_latin1(c: Column, encoding: str) -> Column:
    """Decode a string that a reader decoded as ISO-8859-1 (which keeps every byte)."""
    enc = normal_encoding(encoding)
    if enc == "latin-1":
        return c
    if enc == "cp1252":
        return latin1_as_cp1252(c)
    text = F.encode(c, "ISO-8859-1").cast("string")
    if enc == "utf-8":
        return F.when(is_ascii(c), c).otherwise(F.make_valid_utf8(text))
    return (
        F.when(is_ascii(c), c)
        .when(F.is_valid_utf8(text), text)
        .otherwise(F.translate(c, _CP1252_FROM, _CP1252_TO))
    )


def normal_encoding(name: str | None) -> str:
    key = (name or "auto").lower().replace("_", "-")
    if key in ("utf-8", "utf8", "utf8-lossy", "utf-8-sig"):
        return "utf-8"
    if key in ("cp1252", "windows-1252"):
        return "cp1252"
    if key in ("latin-1", "latin1", "iso-8859-1"):
        return "latin-1"
    if key == "auto":
        return "auto"
    raise ValueError(f"unsupported encoding: {name}")
