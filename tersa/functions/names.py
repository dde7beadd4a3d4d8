"""Tests on column names. They work on a Column of names (profile rows) as well as on a literal."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tersa.functions import vocabulary as V


def _pattern(words=(), prefixes=(), suffixes=(), exact=()) -> str:
    parts = [re.escape(w) for w in words]
    parts += [f"^{re.escape(p)}" for p in prefixes]
    parts += [f"{re.escape(s)}$" for s in suffixes]
    parts += [f"^{re.escape(e)}$" for e in exact]
    return "|".join(parts)


def has_word(name: Column, words: list[str]) -> Column:
    return F.lower(name).rlike(_pattern(words))


def is_id_name(name: Column, words: list[str]) -> Column:
    return F.lower(name).rlike(_pattern(words, V.ID_PREFIXES, V.ID_SUFFIXES))


def is_percent_name(name: Column) -> Column:
    pattern = _pattern((), V.PERCENT_PREFIXES, V.PERCENT_SUFFIXES, V.PERCENT_NAMES)
    return F.trim(F.lower(name)).rlike(pattern)
