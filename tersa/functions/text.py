"""Text expressions: whitespace, case and token tests. Column in, Column out."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tersa.functions import vocabulary as V

# Every character that Unicode calls white space; Spark's own trim knows U+0020 only.
_SPACE_POINTS = [
    0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
SPACE_CHARS = "".join(map(chr, _SPACE_POINTS))
SPACE = r" \t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Remove white space at both ends."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def collapse_spaces(c: Column) -> Column:
    """Turn each run of white space into one blank and strip the ends."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def has_excess_whitespace(c: Column) -> Column:
    return (c != strip(c)) | c.contains("  ")


def is_all_caps(c: Column) -> Column:
    """More than two characters, at least one capital and no lower-case or title-case letter.

    One linear regex: possessive runs mean that it never backtracks.
    """
    small = r"\p{javaLowerCase}\p{Lt}"
    caps = rf"^[^{small}\p{{javaUpperCase}}]*+\p{{javaUpperCase}}[^{small}]*+$"
    stripped = strip(c)
    return (F.length(stripped) > 2) & stripped.rlike(rf"(?s){caps}")


def is_code_token(c: Column) -> Column:
    return c.rlike(f"^{V.CODE_TOKEN}$")


def contains_any(c: Column, needles: list[str]) -> Column:
    return reduce(or_, [c.contains(n) for n in needles])


def is_yes(c: Column) -> Column:
    return F.lower(c).isin(V.YES_TOKENS)


def is_boolean_token(c: Column) -> Column:
    return F.lower(c).isin(V.BOOLEAN_TOKENS)


def _title_token(token: Column) -> Column:
    word = strip(token)
    keep = F.upper(word).isin(V.ACRONYMS) | is_code_token(word)
    first = F.upper(F.substring(word, 1, 1))
    rest = F.lower(word.substr(F.lit(2), F.length(word)))
    return F.when(keep, F.upper(word)).otherwise(F.concat(first, rest))


def title_stripped(s: Column) -> Column:
    """Title case that keeps business acronyms and code-like tokens in capitals.

    Values without such a token (nearly all of them) take ``initcap``, which stays inside
    generated code; only the others pay for the token-by-token path. ``s`` is stripped text and
    should be a plain column.
    """
    acronyms = "|".join(re.escape(a) for a in V.ACRONYMS)
    odd_space = SPACE.replace(" ", "", 1)
    special = s.rlike(rf"(^| )((?i:{acronyms})|{V.CODE_TOKEN})( |$)|[{odd_space}]")
    by_token = F.array_join(F.transform(F.split(s, " "), _title_token), " ")
    return F.when(special, by_token).otherwise(F.initcap(s))


def smart_title(c: Column) -> Column:
    return title_stripped(strip(c))


def map_values(c: Column, mappings: dict[str, str]) -> Column:
    """Exact-value replacement from a small dictionary."""
    entries = F.create_map(*[F.lit(x) for pair in mappings.items() for x in pair])
    return F.when(F.map_contains_key(entries, c), F.try_element_at(entries, c)).otherwise(c)
