"""Masking of personal data over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersa.functions import vocabulary as V
from tersa.functions.masks import mask_value
from tersa.operators.catalog import TEXT, column_kinds


def mask_by_hint(df: DataFrame, hints: dict[str, str], embedded_phones: bool = False) -> DataFrame:
    """Mask the columns hinted name, email, phone or unknown; others pass unchanged.

    A column without a hint counts as unknown: its e-mail addresses and whole-value telephone
    numbers are masked. Only text columns are touched, except by a name, email or phone hint.
    """
    kinds = column_kinds(df)
    masked = {}
    for name in df.columns:
        hint = hints.get(name, "unknown")
        c = F.col(f"`{name}`")
        if hint in V.HINT_MASKS:
            masked[name] = mask_value(c.cast("string"), hint, embedded_phones)
        elif hint == "unknown" and kinds[name] == TEXT:
            masked[name] = mask_value(c, hint, embedded_phones)
    return df.withColumns(masked) if masked else df


def mask_embedded(df: DataFrame, columns: list[str], embedded_phones: bool = False) -> DataFrame:
    """Mask personal data inside the given free-text columns."""
    return df.withColumns({c: mask_value(F.col(f"`{c}`"), "unknown", embedded_phones) for c in columns})


def hints_of(profile_rows) -> dict[str, str]:
    """Hints by column name from collected profile (or fact) rows."""
    return {r.column_name: r.semantic_hint for r in profile_rows}


def masked_sample(
    df: DataFrame, hints: dict[str, str], limit: int = 3, order_by: str | None = None
) -> DataFrame:
    """The first rows, masked."""
    first = df.orderBy(F.col(f"`{order_by}`")).limit(limit) if order_by else df.limit(limit)
    return mask_by_hint(first, hints)
