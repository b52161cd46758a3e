"""Numeric expressions: measure parsing, differences, presence, tolerance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from posrecon.config import UNIT_PRICE

# Labels of the presence classes and of the tolerance check.
ONLY_BAU = "Present only in BAU"
ONLY_TEST = "Present only in TEST"
IN_BOTH = "Present in Both"
PASS = "Pass"
FAIL = "Fail"

_KEEP = r"[^0-9.eE+\-]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_measure(c: Column | str) -> Column:
    """Text to double, null where nothing numeric remains.

    Everything but digits, ``. e E + -`` is removed first. Most values are plain
    numbers already and are cast directly; the regular expression runs only where
    that fails. Texts with an n or x (NaN, Infinity, hexadecimal), which the cast
    reads differently, always take the second way. Each cast appears once, which
    keeps the generated code small enough to be compiled.
    """
    text = _col(c).cast("string")
    special = F.lit(False)
    for letter in "nNxX":
        special = special | F.contains(text, F.lit(letter))
    direct = F.when(~special, text.try_cast("double"))
    return F.coalesce(direct, F.regexp_replace(text, _KEEP, "").try_cast("double"))


def safe_numeric(c: Column | str) -> Column:
    """``parse_measure`` with unusable values counted as 0.0."""
    return F.coalesce(parse_measure(c), F.lit(0.0))


def coerce_numeric(c: Column | str) -> Column:
    """Strict parse of the text as it stands; bad values become 0.0."""
    return F.coalesce(_col(c).try_cast("double"), F.lit(0.0))


def is_bad_measure(c: Column | str) -> Column:
    """True for a non-empty text that does not hold a number."""
    text = _col(c).cast("string")
    return text.isNotNull() & (F.trim(text) != "") & parse_measure(c).isNull()


def scaled(c: Column, implied: bool) -> Column:
    """Implied decimals: the last two digits are the fraction."""
    return c / F.lit(100) if implied else c


def line_total(units: Column, price: Column, price_type: str) -> Column:
    return units * price if price_type == UNIT_PRICE else price


def pct_diff(base: Column | str, comp: Column | str) -> Column:
    """(base - comp) / base * 100; both zero 0, base zero -100, comp zero 100."""
    b, c = _col(base), _col(comp)
    return (
        F.when((b == 0) & (c == 0), 0.0)
        .when(b == 0, -100.0)
        .when(c == 0, 100.0)
        .otherwise((b - c) / b * 100)
    )


def abs_diff(a: Column | str, b: Column | str, name: str) -> Column:
    """Signed difference a - b, named ``name``."""
    return (_col(a) - _col(b)).alias(name)


def fraction_change(base: Column | str, comp: Column | str) -> Column:
    """(comp - base) / base as a fraction; 0 where the base is zero or null."""
    b, c = _col(base), _col(comp)
    return F.coalesce(F.try_divide(c - b, b), F.lit(0.0))


def classify_presence(
    bau: Column | str,
    test: Column | str,
    name: str = "Present In",
    bau_label: str = ONLY_BAU,
    test_label: str = ONLY_TEST,
    both_label: str = IN_BOTH,
) -> Column:
    """Which side a joined row comes from; use before nulls are filled."""
    b, t = _col(bau), _col(test)
    return (
        F.when(b.isNull() & t.isNotNull(), test_label)
        .when(t.isNull() & b.isNotNull(), bau_label)
        .otherwise(both_label)
        .alias(name)
    )


def within_tolerance(
    c: Column | str, tolerance: float, pass_label: str = PASS, fail_label: str = FAIL
) -> Column:
    """|c| <= tolerance; a null difference fails."""
    return F.when(F.abs(_col(c)) <= tolerance, pass_label).otherwise(fail_label)


#: Size of the lower part of a scaled value.
_LOW = 1 << 16
#: Upper parts below it and lower parts below 2^16 times it are joined as longs.
_FITS = 1 << 46


def exact_parts(c: Column | str, scale: int = 4) -> tuple[Column, Column]:
    """The scaled whole number of a double in two longs, multiples of 2^16 and the rest, for :func:`exact_joined`."""
    scaled = F.rint(_col(c) * float(10**scale))
    high = F.floor(scaled / float(_LOW))
    low = scaled - high * float(_LOW)
    return high.cast("long"), low.cast("long")


def exact_joined(high: Column | str, low: Column | str, scale: int = 4) -> Column:
    """The sum of values given by their :func:`exact_parts`; an aggregate."""
    h, l = F.sum(_col(high)), F.sum(_col(low))
    # Most sums fit a long and need no decimal; both ways round the same whole number.
    whole = h.cast("decimal(30,0)") * F.lit(_LOW).cast("decimal(6,0)") + l.cast("decimal(20,0)")
    fits = (F.abs(h) < F.lit(_FITS)) & (l < F.lit(_FITS * _LOW))
    return F.when(fits, (h * F.lit(_LOW) + l).cast("double")).otherwise(whole.cast("double")) / float(10**scale)


def exact_sum(c: Column | str, scale: int = 4) -> Column:
    """Sum of doubles that does not depend on row order (``scale`` decimals kept).

    Scaled whole numbers are summed in two parts (multiples of 2^16, and the rest), each in fast long
    arithmetic, and joined as a decimal. Under ANSI mode a sum beyond 6e23 / 10^scale fails.
    """
    return exact_joined(*exact_parts(c, scale), scale)


def total(c: Column | str, exact: bool | int = False) -> Column:
    """Plain double sum, or an exact one with 4 (``True``) or the given decimals."""
    if exact is False:
        return F.sum(_col(c))
    return exact_sum(c, decimals(exact))


def decimals(exact: bool | int) -> int:
    """Decimals that an exact sum keeps: 4 for ``True``, else the given number."""
    return 4 if exact is True else exact
