"""Secret scans: three fixed patterns, and windows of high entropy.

Base kinds (``assign``, ``access``, ``hex``) are regular expressions; a match that is too
short is dropped. ``entropy`` spans come from candidate strings (runs of 20 and more
characters of one class; spans of two classes that overlap count as one): a window of 20 characters slides over the candidate and keeps
the count of every character; counts change by the character that enters and the one
that leaves, and with them the sum of ``c * log2(c)`` that gives Shannon's entropy. The
span runs from the first to the last window that reaches the threshold of the class.
A candidate is not scanned if the allow-list has its form (see ``ALLOWED``), and a span is not
reported a second time where base spans cover the whole of it.

Positions are code points, the end exclusive; they come from the lengths of the matches
and of the text between them. Only built-in functions run. A null or empty text has no spans;
repeated rows are scanned alike; an empty table gives an empty result. Time grows with the text, also for one
candidate of a megabyte or for a hundred thousand spans. Other columns are
not looked at (``redact`` hands them through whatever their names).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from posrecon.llm.common import let

#: Kinds in order, pattern, group whose length counts, least length.
BASE = (
    (
        "assign",
        "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        1,
        12,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),
)
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharClass:
    """A candidate is a match of ``candidate``, at least a window long; its windows need ``bits``.

    Long words reach the entropy of random letters, so the three classes of bare letters and digits
    ask for more than that: ``lower`` and ``upper`` for digits between the letters, ``mixed`` for two
    places where capitals follow a small letter closer than in words.
    """

    name: str
    candidate: str
    bits: float


@dataclass(frozen=True)
class Scan:
    window: int = 20
    classes: tuple[CharClass, ...] = (
        CharClass("hex_upper", "(?<![A-Za-z0-9+/_=-])(?=[A-F]*[0-9])(?=[0-9]*[A-F])[0-9A-F]{20,}(?![A-Za-z0-9+/_=-])", 2.9),
        CharClass(
            "base64",
            "(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])"
            "[A-Za-z0-9+/_=-]{20,}",
            3.6,
        ),
        CharClass("lower", "(?<![A-Za-z0-9])(?=[a-z]*[0-9]+[a-z]+[0-9])[a-z0-9]{20,}(?![A-Za-z0-9])", 3.4),
        CharClass("upper", "(?<![A-Za-z0-9])(?=[A-F0-9]*[G-Z])(?=[0-9]*[A-Z]+[0-9]+[A-Z])[A-Z0-9]{20,}(?![A-Za-z0-9])", 3.4),
        CharClass("mixed", "(?<![A-Za-z0-9])(?=(?:[A-Za-z]*?[a-z][A-Z][a-z]?[A-Z]){2})[A-Za-z]{20,}(?![A-Za-z0-9])", 3.6),
    )


#: Forms that look random but are no secrets: UUIDs, names of many parts, paths, dotted or padded rules.
ALLOWED = (
    "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
    "|^([A-Za-z]*[0-9]{0,4}[-_/=+]+)+[A-Za-z]*[0-9]{0,4}$"
    "|(?i:example|sample|dummy|placeholder|changeme|lorem)"
)
PRODUCTION = Scan()


_SPAN = "struct<start:int,end:int,match:string>"
#: Values of an array that are folded together; longer arrays are folded in chunks, and then the chunks' ends.
CHUNK = 256


def _running(values: Column, op, zero: Column) -> Column:
    """``op`` over all values up to each, in time that grows with their number (up to tens of millions).

    A fold that appends copies what it has, so folds stay short: chunks are folded one by one, and each goes on
    from the running value of the chunks before it.
    """

    def folded(xs: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out")).cast("struct<at:int,out:array<int>>")
        step = lambda acc, x: let(
            op(acc["at"], x), lambda v: F.struct(v.alias("at"), F.concat(acc["out"], F.array(v)).alias("out"))
        ).cast("struct<at:int,out:array<int>>")
        return F.aggregate(xs, start, step, lambda acc: acc["out"])

    def joined(parts: Column) -> Column:
        ends = folded(F.transform(parts, lambda c: F.element_at(c, -1)))
        before = lambda e, k: F.when(k > 0, F.get(e, k - 1)).otherwise(zero)
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda c, k: let(before(e, k), lambda v: F.transform(c, lambda x: op(v, x))))))

    def chunks(xs: Column) -> Column:
        count = F.ceil(F.size(xs) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda k: folded(F.slice(xs, k * CHUNK + 1, F.lit(CHUNK))))

    return let(values, lambda xs: F.when(F.size(xs) <= CHUNK, folded(xs)).otherwise(let(chunks(xs), joined)))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _placed(text: Column, pattern: str, keep) -> Column:
    """(start, end, match) of the matches that ``keep`` accepts."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(m: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, 1, F.size(m)), m, lambda g, x: F.length(g) + F.length(x))
        placed = lambda ends: F.zip_with(
            m, ends, lambda x, end: F.struct((end - F.length(x)).alias("start"), end.alias("end"), x.alias("match"))
        )
        return F.filter(let(_running(steps, _plus, F.lit(0)), placed), lambda s: keep(s["match"]))

    none = F.array().cast(f"array<{_SPAN}>")
    return let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(spans(m).cast(f"array<{_SPAN}>")))


def _spans(text: Column, pattern: str, group: int, least: int) -> Column:
    counted = lambda m: F.length(F.regexp_extract(m, pattern, group)) >= least
    return F.transform(_placed(text, pattern, counted), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


#: Counts of a window fit in 5 bits each, 12 to a number; letters, digits and marks have codes below 128.
_BITS, _PACKED = 5, 12
_WORDS = -(-128 // _PACKED)


def _entropy_reach(candidate: Column, window: int, bits: float) -> Column:
    """(first, last): start of the first and end of the last window with ``bits`` or more.

    The counts of all characters in the window are packed in a few numbers: one character in and one out change
    one number each.
    """
    if window >= 1 << _BITS:
        raise ValueError(f"a window holds fewer than {1 << _BITS} characters")
    terms = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)))
    state = "struct<counts:array<bigint>,total:double,first:int,last:int>"
    zero = F.struct(
        F.array_repeat(F.lit(0).cast("long"), _WORDS).alias("counts"), F.lit(0.0).alias("total"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    ).cast(state)
    goal = window * (math.log2(window) - bits) + 1e-9
    powers = F.array(*(F.lit(1 << _BITS * k).cast("long") for k in range(_PACKED)))
    word = lambda code: F.floor(code / _PACKED).cast("int")
    unit = lambda code: F.get(powers, code % _PACKED)

    def count(counts: Column, code: Column) -> Column:
        packed = F.get(counts, word(code)).bitwiseAND(unit(code) * ((1 << _BITS) - 1))
        return F.floor(packed / unit(code)).cast("int")

    def scanned_codes(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            new, old = F.get(codes, i - 1), F.when(i > window, F.get(codes, i - window - 1)).otherwise(-1)

            def moved(x: Column) -> Column:
                counts, n, o = acc["counts"], x["n"], x["o"]
                # A character that replaces its like changes nothing.
                same = x["new"] == x["old"]
                total = F.when(same, acc["total"]).otherwise(
                    acc["total"] + F.get(terms, n + 1) - F.get(terms, n)
                    + F.when(x["old"] >= 0, F.get(terms, o - 1) - F.get(terms, o)).otherwise(0.0)
                )
                shifted = F.when(same, counts).otherwise(F.transform(
                    counts,
                    lambda c, k: c + F.when(k == word(x["new"]), unit(x["new"])).otherwise(0)
                    - F.when((x["old"] >= 0) & (k == word(x["old"])), unit(x["old"])).otherwise(0),
                ))
                return F.struct(shifted.alias("counts"), total.alias("total"), i.alias("i"))

            def marked(y: Column) -> Column:
                reached = (i >= window) & (y["total"] <= goal)
                return F.struct(
                    y["counts"].alias("counts"), y["total"].alias("total"),
                    F.when(reached & acc["first"].isNull(), i - window).otherwise(acc["first"]).alias("first"),
                    F.when(reached, i).otherwise(acc["last"]).alias("last"),
                ).cast(state)

            seen = F.struct(
                new.alias("new"), old.alias("old"), count(acc["counts"], new).alias("n"),
                F.when(old >= 0, count(acc["counts"], old)).alias("o"),
            )
            return let(let(seen, moved), marked)

        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), zero, step)

    codes = F.transform(F.split(candidate, ""), F.ascii)
    return let(let(codes, scanned_codes), lambda d: F.struct(d["first"].alias("first"), d["last"].alias("last")))


_PLAIN_SPAN = "struct<start:int,end:int>"


def _merged(spans: Column, touching: bool = False) -> Column:
    """Spans by start; those that overlap (or touch, on demand) become one."""

    def groups(x: Column) -> Column:
        s, reach = x["s"], x["reach"]
        before = lambda i: F.get(reach, i - 1)
        opens = lambda v, i: (i == 0) | ((v["start"] > before(i)) if touching else (v["start"] >= before(i)))
        begins = F.filter(F.transform(s, lambda v, i: F.when(opens(v, i), i)), lambda i: i.isNotNull())
        closed = lambda b: F.transform(
            b,
            lambda i, k: F.struct(
                F.get(s, i)["start"].alias("start"),
                F.get(reach, F.coalesce(F.get(b, k + 1), F.size(s)) - 1).alias("end"),
            ),
        )
        return let(begins, closed)

    def ordered(s: Column) -> Column:
        reach = _running(F.transform(s, lambda v: v["end"]), F.greatest, F.lit(-1))
        return let(F.struct(s.alias("s"), reach.alias("reach")), groups)

    none = F.array().cast(f"array<{_PLAIN_SPAN}>")
    plain = F.transform(spans, lambda v: F.struct(v["start"].alias("start"), v["end"].alias("end")))
    return let(F.sort_array(plain), lambda s: F.when(F.size(s) == 0, none).otherwise(ordered(s).cast(f"array<{_PLAIN_SPAN}>")))


def _reached(candidates: Column, cls: CharClass, scan: Scan) -> Column:
    moved = lambda s: let(
        _entropy_reach(s["match"], scan.window, cls.bits),
        lambda r: F.struct((s["start"] + r["first"]).alias("start"), (s["start"] + r["last"]).alias("end")),
    )
    return F.filter(F.transform(candidates, moved), lambda s: s["start"].isNotNull())


def scanned(docs: DataFrame, scan: Scan = PRODUCTION) -> DataFrame:
    """``docs`` as a struct ``row_`` with one array of (start, end) spans per kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select(F.struct("*").alias("row_"), text.alias("text_"))
    text = F.col("text_")
    out = out.withColumns({kind: _spans(text, *rest) for kind, *rest in BASE})
    # Every class asks for a run like this. Steps are columns of their own: one expression would nest too deep.
    none = F.array().cast(f"array<{_SPAN}>")
    out = out.withColumn("run_", text.rlike("[A-Za-z0-9+/_=-]{20}"))
    found = {f"c{k}_": _placed(text, c.candidate, lambda m: ~m.rlike(ALLOWED)) for k, c in enumerate(scan.classes)}
    out = out.withColumns({name: F.when(F.col("run_"), spans).otherwise(none) for name, spans in found.items()})
    out = out.withColumns({name: _reached(F.col(name), c, scan) for name, c in zip(found, scan.classes)})
    out = out.withColumn("entropy_", _merged(F.concat(*found)))
    out = out.withColumn("base_", _merged(F.concat("assign", "access", "hex"), touching=True))
    side = lambda c, own: F.transform(c, lambda v: F.struct(v["start"].alias("start"), F.lit(own).alias("own"), v["end"].alias("end")))
    # Base spans first where both start: merged ones are disjoint, so the last to begin reaches furthest.
    out = out.withColumn("both_", F.sort_array(F.concat(side("base_", False), side("entropy_", True))))
    reach = _running(F.transform("both_", lambda v: F.when(v["own"], -1).otherwise(v["end"])), F.greatest, F.lit(-1))
    out = out.withColumn("reach_", F.when((F.size("entropy_") > 0) & (F.size("base_") > 0), reach))
    uncovered = F.filter("both_", lambda v, i: v["own"] & (F.get("reach_", i) < v["end"]))
    plain = F.transform(uncovered, lambda v: F.struct(v["start"].alias("start"), v["end"].alias("end")))
    return out.withColumn("entropy", F.when(F.col("reach_").isNull(), F.col("entropy_")).otherwise(plain)).select(
        "row_", "text_", *KINDS
    )


def _digest(kinds) -> Column:
    """``kind:start:end`` of all spans by start, then kind in the order of ``KINDS``."""

    def labelled(k: int, kind: str) -> Column:
        label = lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), label(s).alias("s")))

    spans = F.sort_array(F.concat(*(labelled(k, kind) for k, kind in enumerate(kinds))))
    return F.array_join(F.transform(spans, lambda s: s["s"]), ",")


def secret_report(docs: DataFrame, scan: Scan = PRODUCTION) -> DataFrame:
    """Spans of every row of ``docs``, with counts and the digest of the base spans."""
    rows = scanned(docs.select("doc_id", "text"), scan)
    return rows.select(
        "row_.doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind, *_ in BASE),
        F.sha2(_digest(KINDS[:3]), 256).alias("base_sha256"),
        _digest(KINDS).alias("spans"),
        F.size("entropy").cast("long").alias("n_entropy"),
    )


def redact(docs: DataFrame, mask: str = "[SECRET]", scan: Scan = PRODUCTION) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mask``; overlapping spans share one.

    Nulls stay null and all columns keep their names and order.
    """
    rows = scanned(docs, scan)
    # Characters are split once where there are many pieces: cutting a string counts from its start.
    cut = {
        "few": lambda t, start, n: F.substr(t, start + 1, n),
        "many": lambda t, start, n: F.array_join(F.slice(t, start + 1, n), ""),
    }

    def pieces(t: Column, spans: Column, size: Column, how) -> Column:
        end = lambda k: F.coalesce(F.get(spans, k - 1)["end"], F.lit(0))
        masked = F.transform(spans, lambda v, k: F.concat(how(t, end(k), v["start"] - end(k)), F.lit(mask)))
        return F.concat(F.array_join(masked, ""), how(t, end(F.size(spans)), F.greatest(size - end(F.size(spans)), F.lit(0))))

    whole = F.col("text_")
    size = F.length(whole)
    masked = lambda spans: F.when(F.size(spans) <= CHUNK, pieces(whole, spans, size, cut["few"])).otherwise(
        let(F.split(whole, ""), lambda t: pieces(t, spans, size, cut["many"]))
    )
    rows = rows.withColumn("spans_", _merged(F.concat(*KINDS)))
    text = F.when(F.size("spans_") == 0, F.col("row_.text")).otherwise(masked(F.col("spans_")))
    return rows.withColumn("new_", text).select(
        *(F.col("new_").alias(c) if c == "text" else F.col(f"row_.`{c}`").alias(c) for c in docs.columns)
    )
