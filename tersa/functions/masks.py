"""Masking of personal data in one column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tersa.functions import vocabulary as V
from tersa.functions.text import strip


def mask_value(c: Column, hint: str = "unknown", embedded_phones: bool = False) -> Column:
    """Mask a value by its column's hint, or by what the value itself looks like.

    ``embedded_phones=True`` also masks telephone numbers inside longer text (an extension).
    """
    s = strip(c)
    email, phone, name = (F.lit(V.HINT_MASKS[k]) for k in ("email", "phone", "name"))
    is_email = F.lit(True) if hint == "email" else s.rlike(f"^{V.EMAIL}$")
    is_phone = F.lit(True) if hint == "phone" else s.rlike(f"^{V.PHONE}$")
    without_email = F.regexp_replace(s, V.EMAIL, V.HINT_MASKS["email"])
    rest = F.when(s.contains("@") & s.rlike(V.EMAIL), without_email).otherwise(c)
    if embedded_phones:
        rest = F.regexp_replace(rest, rf"(?<!\d){V.PHONE}(?!\d)", V.HINT_MASKS["phone"])
    masked = F.when(is_email, email).when(is_phone, phone).otherwise(name if hint == "name" else rest)
    return F.when(c.isNull() | (s == ""), c).otherwise(masked)
