"""Number expressions: tolerant parsing of European and American number text, rounding, clamping.

``parse_number`` reads a column that is already a plain reference. Operators that read many rows
use ``bare_number_text`` and ``number_from_bare`` in two projections instead: Catalyst does not
merge projections that would repeat an expensive expression, so each regex runs once per value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tersa.functions import vocabulary as V
from tersa.functions.text import SPACE, contains_any, strip

# Possessive quantifiers: the engine neither recurses nor goes back, so a test takes time in proportion to the text.
_DIGITS = r"\d++(?:_\d++)*+"
_FLOAT = rf"[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
_UNSIGNED = r"(?:\d++(?:\.\d*+)?|\.\d++)(?:[eE][+-]?\d++)?"
_STRICT = rf"[+-]?(?:{_UNSIGNED}|(?i:inf(?:inity)?))"
PLAIN_FLOAT = rf"^[{SPACE}]*+[+-]?{_UNSIGNED}[{SPACE}]*+$"
PLAIN_INTEGER = rf"^[{SPACE}]*+[+-]?\d++[{SPACE}]*+$"


def is_missing_marker(c: Column) -> Column:
    return F.lower(strip(c)).isin(V.MISSING_MARKERS) | c.rlike(rf"^[-_—–{SPACE}]+$")


def bare_number_text(c: Column, strict_currency: bool = True) -> Column:
    """Drop symbols, white space and currency words.

    A currency word goes only where it stands alone once the blanks are gone, so ``100 USD`` stays
    unreadable; ``strict_currency=False`` drops the words wherever they are.
    """
    no_symbols = F.regexp_replace(c, f"[€$%{SPACE}]", "")
    word = r"(?iU)\b(usd|eur)\b" if strict_currency else r"(?i)usd|eur"
    return F.regexp_replace(no_symbols, word, "")


def number_from_bare(s: Column) -> Column:
    """Read bare text as a double; European separators are tried before American ones.

    The result may be infinite (``1e999``); ``finite`` is left to the next projection.
    """
    plain = (
        F.when(s.rlike(f"^({V.EU_THOUSANDS}|{V.EU_DECIMAL})$"), F.translate(s, ",.", "."))
        .when(s.rlike(f"^{V.US_THOUSANDS}$"), F.translate(s, ",", ""))
        .when(s.rlike(f"^{_FLOAT}$"), F.translate(s, "_", ""))
    )
    return plain.try_cast("double")


def parse_number(c: Column, strict_currency: bool = True) -> Column:
    return finite(number_from_bare(bare_number_text(c, strict_currency)))


def coerce_number(c: Column) -> Column:
    """Strict reading of number text: no symbols, no thousands separators."""
    s = strip(c)
    return F.when(s.rlike(f"^{_STRICT}$"), s.try_cast("double"))


def finite(x: Column) -> Column:
    """NaN and infinities become NULL (NaN sorts above every number in Spark)."""
    return F.when(F.abs(x) < float("inf"), x)


def has_symbol(c: Column) -> Column:
    return contains_any(c, V.DIRTY_NUMBER_SYMBOLS)


def round_even(x: Column, decimals: int) -> Column:
    """Scale, round half to even, scale back."""
    factor = float(10**decimals)
    return F.rint(x * F.lit(factor)) / F.lit(factor)


def clamp(x: Column, low: float | None, high: float | None) -> Column:
    """Floor, then ceiling; NULL stays NULL."""
    if low is not None:
        x = F.when(x < float(low), F.lit(float(low))).otherwise(x)
    if high is not None:
        x = F.when(x > float(high), F.lit(float(high))).otherwise(x)
    return x


def float_text(x: Column) -> Column:
    """Decimal text of a double the way Python prints it up to 1e16 (Spark switches at 1e7)."""
    spark_text = x.cast("string")
    digits = F.regexp_replace(spark_text.try_cast("decimal(38,18)").cast("string"), "0+$", "")
    long_form = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    size = F.abs(x)
    shown_long = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
    return F.when(shown_long, long_form).otherwise(spark_text)


def format_eur(x: Column) -> Column:
    """``1.234.567,89 €``"""
    return F.concat(F.translate(F.format_number(x, 2), ",.", ".,"), F.lit(" €"))


def format_tenths(x: Column) -> Column:
    """A number rounded to one decimal place, as text."""
    return float_text(round_even(x, 1))
