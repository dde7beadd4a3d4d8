"""Rule tables: which finding leads to which step.

Fixed values: kinds of finding, operation, parameters, confidence and risk. ``phase`` 1 holds the
rules on quality issues, phase 2 the fallbacks on column evidence. ``rank`` orders the rules
within a phase: first by ``place`` (report order of the dimensions), then by column, then ``rank``.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tersa.functions import vocabulary as V
from tersa.sources.local import local_frame

RULE_COLUMNS = (
    "kind string, phase int, place int, rank int, operation string, parameters string, "
    "reason string, confidence double, risk string"
)

_CONSTANT = {"strategy": "constant", "value": V.DEFAULT_FILL}
_TITLE = {"mode": "title"}
_ISO = {"target_format": "%Y-%m-%d"}
_FLOOR = {"min_value": 0, "max_value": None}
_PERCENT = {"min_value": 0.0, "max_value": 100.0}
_CEILING = {"min_value": None, "max_value": 100.0}
_MEDIAN = {"strategy": "median"}
_AS_TEXT = {**_CONSTANT, "as_text": True}

# kind, phase, place, rank, operation, parameters, reason, confidence, risk
RULES = [
    ("nulls_text", 1, 1, 1, "fill_missing", _CONSTANT, "Rellenar huecos con una constante", 0.85, "medium"),
    ("nulls_compat", 1, 1, 1, "fill_missing", _AS_TEXT, "Rellenar huecos con una constante", 0.85, "medium"),
    ("duplicates", 1, 2, 1, "remove_duplicates", {}, "Quitar filas repetidas", 0.95, "high"),
    ("whitespace", 1, 3, 1, "trim_text", {}, "Quitar espacios de más", 0.98, "low"),
    ("case", 1, 3, 2, "normalize_case", _TITLE, "Unificar mayúsculas conservando siglas", 0.92, "low"),
    ("dates", 1, 4, 1, "convert_datetime", _ISO, "Unificar el formato de fecha", 0.95, "low"),
    ("numbers", 1, 4, 2, "convert_numeric", {}, "Leer como número", 0.95, "medium"),
    ("percent", 1, 5, 1, "clamp_range", _PERCENT, "Acotar el porcentaje", 0.94, "medium"),
    ("negatives", 1, 5, 2, "clamp_range", _FLOOR, "Acotar negativos a cero", 0.94, "medium"),
    # Numeric columns are filled after they have been converted and clamped.
    ("nulls_number", 1, 6, 1, "fill_missing", _MEDIAN, "Rellenar huecos con la mediana", 0.85, "medium"),
    ("any_caps", 2, 7, 1, "normalize_case", _TITLE, "Unificar mayúsculas conservando siglas", 0.92, "low"),
    ("any_space", 2, 7, 2, "trim_text", {}, "Quitar espacios de más", 0.95, "low"),
    ("any_mark", 2, 7, 3, "convert_numeric", {}, "Leer como número", 0.95, "medium"),
    ("any_negative", 2, 7, 4, "clamp_range", _FLOOR, "Acotar negativos a cero", 0.94, "medium"),
    ("any_off_percent", 2, 7, 5, "clamp_range", _PERCENT, "Acotar el porcentaje", 0.94, "medium"),
]

# The alternative set: no imputation, one-sided clamps, fallbacks on names and hints.
SAMPLED_RULES = [
    ("duplicates", 1, 2, 1, "remove_duplicates", {}, "Quitar filas repetidas", 0.98, "high"),
    ("whitespace", 1, 3, 1, "trim_text", {}, "Quitar espacios de más", 0.95, "low"),
    ("case", 1, 3, 2, "normalize_case", _TITLE, "Unificar mayúsculas conservando siglas", 0.92, "low"),
    ("dates", 1, 4, 1, "convert_datetime", _ISO, "Unificar el formato de fecha", 0.96, "medium"),
    ("numbers", 1, 4, 2, "convert_numeric", {}, "Leer como número", 0.95, "medium"),
    ("percent", 1, 5, 1, "clamp_range", _CEILING, "Acotar el porcentaje por arriba", 0.94, "medium"),
    ("negatives", 1, 5, 2, "clamp_range", _FLOOR, "Acotar negativos a cero", 0.94, "medium"),
    ("sampled_caps", 2, 7, 1, "normalize_case", _TITLE, "Unificar mayúsculas conservando siglas", 0.92, "low"),
    ("sampled_mark", 2, 7, 2, "convert_numeric", {}, "Leer como número", 0.95, "medium"),
    ("sampled_negative", 2, 7, 3, "clamp_range", _FLOOR, "Acotar negativos a cero", 0.93, "medium"),
    ("sampled_over", 2, 7, 4, "clamp_range", _CEILING, "Acotar el porcentaje por arriba", 0.93, "medium"),
]

RULESETS = {"rules": RULES, "sampled": SAMPLED_RULES}


def rule_table(spark: SparkSession, ruleset: str = "rules") -> DataFrame:
    if ruleset not in RULESETS:
        raise ValueError(f"INVALID_PARAMETER: unknown rule set '{ruleset}'")
    rows = [(*r[:5], json.dumps(r[5], ensure_ascii=False), *r[6:]) for r in RULESETS[ruleset]]
    return local_frame(spark, rows, RULE_COLUMNS)
