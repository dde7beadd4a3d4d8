"""Date expressions: reading mixed date text, naming its format class, strftime output.

The parser re-orders the digits into ``y-m-d`` by regex and casts: the cast answers NULL for an
impossible day without raising, which a formatter-based parser cannot do cheaply.

By default the years 1678 to 2261 are dates (the range of 64-bit nanoseconds) and others are not;
``any_year=True`` takes every four-digit year, such as the 9999-12-31 of open-ended records.
"""

from __future__ import annotations

import re
from functools import lru_cache
from types import SimpleNamespace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tersa.functions import vocabulary as V
from tersa.functions.text import strip

_CLOCK = r"(?:[01]?\d|2[0-3]):[0-5]?\d(?::[0-5]?\d(?:\.\d{1,9})?)?"
_TIME = rf"([T ]{_CLOCK}(?: ?[AaPp][Mm])?(?:Z|[+-]\d{{2}}:?\d{{2}})?|[T ](?:[01]\d|2[0-3]))?"
# The years 1678 to 2261; English month names, in full and short.
_YEARS = r"(167[89]|16[89]\d|1[7-9]\d\d|2[01]\d\d|22[0-5]\d|226[01])"
_MONTHS = (
    "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|"
    "Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
)


@lru_cache
def _patterns(any_year: bool) -> SimpleNamespace:
    year = r"(\d{4})" if any_year else _YEARS
    month = rf"(?i:({_MONTHS}))"
    return SimpleNamespace(
        iso=rf"^{year}[-/](\d{{1,2}})[-/](\d{{1,2}}){_TIME}$",
        day_first=rf"^(\d{{1,2}})[-/](\d{{1,2}})[-/]{year}{_TIME}$",
        compact=rf"^{year}(\d{{2}})(\d{{2}}){_TIME}$",
        dotted_iso=rf"^{year}\.(\d{{1,2}})\.(\d{{1,2}})$",
        dotted=rf"^(\d{{1,2}})\.(\d{{1,2}})\.{year}$",
        short_year=r"^(\d{1,2})[-/](\d{1,2})[-/](\d{2})$",
        year_month=rf"^{year}-(\d{{1,2}})$",
        year=rf"^{year}$",
        day_name=rf"^(\d{{1,2}})[ -]{month}\.?,?[ -]{year}$",
        name_day=rf"^{month}\.? (\d{{1,2}}),? {year}$",
        name_year=rf"^{month}\.?,?[ -]{year}$",
    )


# Strftime directive -> Spark datetime pattern.
_DIRECTIVES = {
    "Y": "yyyy", "m": "MM", "d": "dd", "y": "yy", "H": "HH", "I": "hh", "M": "mm", "S": "ss",
    "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "f": "SSSSSS",
}
_TIME_DIRECTIVES = set("HIMSpf")

# Format classes, in the order that settles a tie.
FORMAT_CLASSES = ["iso-", "iso/", "dmy-", "dmy/", "iso-T", "iso/T", "dmy-T", "dmy/T", "other"]


def _reorder(s: Column, pattern: str, template: str, kind: str) -> Column:
    return F.regexp_replace(s, pattern, template).try_cast(kind)


def read_stripped(s: Column, kind: str = "date", any_year: bool = False) -> Column:
    """Read stripped text as ``date`` or ``timestamp``.

    Year-first text is read year-month-day. Day-first text is read day-month-year, and
    month-day-year only when the former is impossible. A missing month or day is the first.
    ``s`` is referred to many times: pass a plain column.
    """
    p = _patterns(any_year)
    clock = "$4" if kind == "timestamp" else ""

    def either(pattern: str, *templates: str) -> Column:
        return F.coalesce(*[_reorder(s, pattern, t, kind) for t in templates])

    def named(pattern: str, day: str, month: str, year: str) -> Column:
        name = F.initcap(F.substring(F.regexp_replace(s, pattern, month), 1, 3))
        text = F.concat(F.regexp_replace(s, pattern, day), F.lit(" "), name, F.regexp_replace(s, pattern, " " + year))
        return F.try_to_timestamp(text, F.lit("d MMM yyyy")).cast(kind)

    # An hour without minutes: the cast wants both.
    hour_only = F.regexp_replace(s, r"([T ])(\d{2})$", "$1$2:00")
    timed = F.when(s.rlike(r"\d[T ]\d{2}$"), hour_only).otherwise(s) if kind == "timestamp" else s

    def dated(pattern: str, *templates: str) -> Column:
        return F.coalesce(*[_reorder(timed, pattern, t, kind) for t in templates])

    read = (
        F.when(s.rlike(p.iso), dated(p.iso, f"$1-$2-$3{clock}"))
        .when(s.rlike(p.day_first), dated(p.day_first, f"$3-$2-$1{clock}", f"$3-$1-$2{clock}"))
        .when(s.rlike(p.compact), dated(p.compact, f"$1-$2-$3{clock}"))
        .when(s.rlike(p.dotted_iso), either(p.dotted_iso, "$1-$2-$3"))
        .when(s.rlike(p.dotted), either(p.dotted, "$3-$1-$2", "$3-$2-$1"))
        .when(s.rlike(p.short_year), either(p.short_year, "20$3-$1-$2", "20$3-$2-$1"))
        .when(s.rlike(p.year_month), either(p.year_month, "$1-$2-1"))
        .when(s.rlike(p.year), either(p.year, "$1-1-1"))
        .when(s.rlike(p.day_name), named(p.day_name, "$1", "$2", "$3"))
        .when(s.rlike(p.name_day), named(p.name_day, "$2", "$1", "$3"))
        .when(s.rlike(p.name_year), named(p.name_year, "1", "$1", "$2"))
    )
    # No pattern fits shorter or longer text; most other text is turned away here.
    return F.when(F.length(s).between(4, 40), read)


def parse_date(c: Column, any_year: bool = False) -> Column:
    """Date text of mixed formats -> DATE; unreadable text -> NULL."""
    return read_stripped(strip(c), any_year=any_year)


def parse_timestamp(c: Column, any_year: bool = False) -> Column:
    return read_stripped(strip(c), "timestamp", any_year)


def is_invalid_date(c: Column, parsed: Column) -> Column:
    """Text that says something but is no date (blank-like tokens are merely absent)."""
    return c.isNotNull() & ~F.lower(strip(c)).isin(V.DATE_BLANK_TOKENS) & parsed.isNull()


def strftime(c: Column, target_format: str) -> Column:
    return F.date_format(c, java_pattern(target_format))


def wants_time(target_format: str) -> bool:
    return any(f"%{d}" in target_format for d in _TIME_DIRECTIVES)


def java_pattern(target_format: str) -> str:
    """Translate a strftime format; an unknown directive is refused."""
    out = ""
    for directive, literal in re.findall(r"%([^%]|$)|((?:[^%]|%%)+)", target_format):
        if literal:
            out += "'" + literal.replace("%%", "%").replace("'", "''") + "'"
        elif directive in _DIRECTIVES:
            out += _DIRECTIVES[directive]
        else:
            raise ValueError(f"INVALID_PARAMETER: unsupported date directive '%{directive}'")
    return out


def format_class(c: Column, parsed: Column) -> Column:
    """Position (1-based) of the value's class in FORMAT_CLASSES; NULL if it is no date."""
    s = strip(c)
    index = {name: F.lit(i + 1) for i, name in enumerate(FORMAT_CLASSES)}
    timed = s.contains(":")

    def pick(name: str) -> Column:
        return F.when(timed, index[f"{name}T"]).otherwise(index[name])

    label = (
        F.when(s.rlike(r"^\d{4}-\d"), F.when(s.rlike(_patterns(True).year_month), index["other"]).otherwise(pick("iso-")))
        .when(s.rlike(r"^\d{4}/\d"), pick("iso/"))
        .when(s.rlike(r"^\d{1,2}-\d{1,2}-\d{4}"), pick("dmy-"))
        .when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}"), pick("dmy/"))
        .otherwise(index["other"])
    )
    return F.when(parsed.isNotNull(), label)
