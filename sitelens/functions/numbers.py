"""Numbers as text, text as numbers, and the two rounding rules."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, functions as F

# The white space a JavaScript-style trim removes.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

DECIMAL_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,2})?$"


def strip(value: Column) -> Column:
    """Trim every Unicode space from both ends (plain ``trim`` removes U+0020 only).

    A value that starts and ends with a printable ASCII character needs no trimming;
    the test is much cheaper than the general trim.
    """
    bare = F.ascii(value).between(33, 126) & F.ascii(F.substring(value, -1, 1)).between(33, 126)
    return F.when(bare, value).otherwise(F.btrim(value, F.lit(WHITE_SPACE)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it.

    A plain column expression is copied to every place that names it. Parsers nested that way
    repeat their regexes many times a row, and grow beyond what HotSpot compiles.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_decimal(text: Column, dtype: str = "decimal(24,6)") -> Column:
    """Decimal value of a plain trimmed number, null for anything else (blank included)."""
    return F.when(text.rlike(DECIMAL_TEXT), text.try_cast(dtype))


def round_half_up(value: Column, digits: int) -> Column:
    """Round ties toward +infinity, for figures computed by application code.

    SQL ``round`` goes away from zero; the two differ on negative ties only.
    """
    scale = F.lit(10 ** digits)
    return F.floor(value * scale + F.lit(0.5)) / scale


def money_half_up(value: Column) -> Column:
    """Decimal value to two places, ties toward +infinity, as DECIMAL(14,2)."""
    cents = F.floor(value * F.lit(100) + F.expr("0.5BD"))
    below_zero = (cents.try_cast("decimal(20,0)") * F.expr("0.01BD")).try_cast("decimal(14,2)")
    return F.when(value >= 0, F.round(value, 2).try_cast("decimal(14,2)")).otherwise(below_zero)


def plain(value: Column) -> Column:
    """Decimal as text without trailing zeros: 84030.00 -> 84030, 1.50 -> 1.5."""
    text = value.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def percent_change(actual: Column, baseline: Column) -> Column:
    """Change against a baseline in percent to one decimal; 0 when there is no baseline."""
    change = (actual - baseline) / baseline * F.lit(100.0)
    return F.when(baseline == 0, F.lit(0.0)).otherwise(round_half_up(change, 1))
