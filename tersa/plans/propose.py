"""Propose a cleaning plan: findings joined with a rule table, ranked, one step per need.

Findings may cover many tables (``dataset``); they hold a few rows per column. The rule table has
a fixed size and is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tersa.functions import names
from tersa.functions import vocabulary as V
from tersa.operators import catalog
from tersa.operators.analysis import Analysis
from tersa.operators.catalog import NUMBER
from tersa.operators.profile import _analysis
from tersa.operators.quality import _issue_rows, is_percent_column
from tersa.plans.rules import rule_table
from tersa.plans.steps import Step, collect_steps
from tersa.sources.local import local_frame


def _issue_findings(analysis: Analysis, compat: bool) -> DataFrame:
    """Quality issues as findings (phase 1)."""
    kind = F.col("kind")
    ranged = kind.isin("percent_range", "negatives")
    nulls = "nulls_compat" if compat else F.when(F.col("is_numeric"), "nulls_number").otherwise("nulls_text")
    # A range issue in a percentage column asks for both bounds, whatever it was found by.
    finding = (
        F.when(kind == "nulls", nulls)
        .when(ranged & F.col("is_percent"), "percent")
        .when(kind == "percent_range", "percent")
        .otherwise(kind)
    )
    return _issue_rows(analysis).select(
        "position", "column", finding.alias("kind"), F.col("affected_rows").alias("estimate")
    )


def _fallback_findings(analysis: Analysis, compat: bool) -> DataFrame:
    """Column evidence as findings (phase 2 of the default rule set)."""
    name = F.col("column_name")
    identifier = names.is_id_name(name, V.ID_WORDS_PLAN)
    measured = F.col("kind").isin(NUMBER, "date") | names.has_word(name, V.QUANTITY_OR_DATE_WORDS)
    percent = is_percent_column()
    present = F.col("rows") - F.col("nulls")
    readable = F.lit(True) if compat else (
        (F.col("inferred_type") == "numeric") | (F.col("parsed") >= present * 0.5)
    )
    out = F.col("negatives") + F.col("over_hundred")
    return _findings(analysis, {
        "any_caps": (~identifier & ~measured & (F.col("all_caps") > 0), F.col("rows")),
        "any_space": (F.col("excess_space") > 0, F.col("rows")),
        "any_mark": (~identifier & F.col("number_marks") & readable, F.col("rows")),
        "any_negative": (~identifier & ~percent & (F.col("negatives") > 0), F.col("negatives")),
        "any_off_percent": (~identifier & percent & (out > 0), out),
    })


def _sampled_findings(analysis: Analysis) -> DataFrame:
    """Column evidence as findings for the alternative rule set."""
    name, hint = F.col("column_name"), F.col("semantic_hint")
    labelled = hint.isin("name", "location") | names.has_word(name, V.SAMPLED_NAME_WORDS)
    measured = (
        hint.isin("currency", "percentage") | (F.col("inferred_type") == "numeric")
        | names.has_word(name, V.SAMPLED_QUANTITY_WORDS)
    )
    percent = (hint == "percentage") | names.has_word(name, V.SAMPLED_PERCENT_WORDS)
    return _findings(analysis, {
        "sampled_caps": (labelled & (F.col("all_caps") > 0), F.col("all_caps")),
        "sampled_mark": (measured & F.col("sampled_marks"), F.col("dirty_numbers")),
        "sampled_negative": (measured & (F.col("negatives") > 0), F.col("negatives")),
        "sampled_over": (measured & percent & (F.col("over_hundred") > 0), F.col("over_hundred")),
    })


def _findings(analysis: Analysis, tests: dict[str, tuple[Column, Column]]) -> DataFrame:
    entries = F.array(*[
        F.when(test, F.struct(F.lit(kind).alias("kind"), estimate.alias("estimate")))
        for kind, (test, estimate) in tests.items()
    ])
    facts = analysis.facts.select(
        "position", F.col("column_name").alias("column"), F.array_compact(entries).alias("found")
    )
    return facts.select("position", "column", F.inline("found"))


def findings(
    source: DataFrame | Analysis, ruleset: str = "rules", compat: bool = False, dataset: str = "", issues: bool = True
) -> DataFrame:
    """(dataset, position, column, kind, estimate) of one table; without ``issues`` only what the fallbacks see."""
    analysis = _analysis(source)
    found = _sampled_findings(analysis) if ruleset == "sampled" else _fallback_findings(analysis, compat)
    if issues:
        found = _issue_findings(analysis, compat).unionByName(found)
    return found.select(F.lit(dataset).alias("dataset"), "*")


def plan_from_findings(found: DataFrame, ruleset: str = "rules") -> DataFrame:
    """Steps for the findings of any number of tables.

    A column gets an operation once: the rules on issues win over the fallbacks, and equal
    parameters are proposed once.
    """
    rules = F.broadcast(rule_table(found.sparkSession, ruleset))
    need = ["dataset", "column", "operation"]
    order = ["phase", "place", "position", "rank"]
    matched = found.join(rules, "kind").withColumns({
        "best": F.min("phase").over(Window.partitionBy(*need)),
        "copy": F.row_number().over(Window.partitionBy(*need, "parameters").orderBy(*order)),
    })
    kept = matched.where((F.col("phase") == F.col("best")) & (F.col("copy") == 1))
    number = F.row_number().over(Window.partitionBy("dataset").orderBy(*order))
    reason = F.when(
        F.col("column").isNotNull(), F.concat("reason", F.lit(": "), F.col("column"))
    ).otherwise(F.col("reason"))
    return kept.select(
        "dataset",
        F.format_string("STEP-%03d", number).alias("step_id"),
        "operation", "column", "parameters", reason.alias("reason"), "confidence", "risk",
        F.col("estimate").cast("bigint").alias("affected_rows_estimate"),
        F.lit("proposed").alias("status"),
    )


def propose_plan(
    source: DataFrame | Analysis, ruleset: str = "rules", compat: bool = False, dataset: str = ""
) -> DataFrame:
    """One row per step, in order of ``step_id``.

    By default a column is only read as numbers if at least half of it parses, and numeric gaps
    get the median after conversion. ``compat=True`` proposes the conversion for any column that
    holds one marker or symbol, and fills every gap with the constant.
    """
    return plan_from_findings(findings(source, ruleset, compat, dataset), ruleset)


def propose_steps(source: DataFrame | Analysis, ruleset: str = "rules", compat: bool = False) -> list[Step]:
    return collect_steps(propose_plan(source, ruleset, compat))


def catalog_table(plan: DataFrame) -> DataFrame:
    rows = [(name,) for name in catalog.list_operations()]
    return local_frame(plan.sparkSession, rows, "operation string")


def guardrail(plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps of the catalog, one warning row per step outside it)."""
    allowed = F.broadcast(catalog_table(plan))
    kept = plan.join(allowed, "operation", "left_semi")
    dropped = plan.join(allowed, "operation", "left_anti").select(
        "step_id", "operation",
        F.concat(F.lit("Operación fuera del catálogo: "), F.col("operation")).alias("warning"),
    )
    return kept, dropped


def union_findings(parts: list[DataFrame]) -> DataFrame:
    """Findings of several tables, to be planned together."""
    return reduce(DataFrame.unionByName, parts)
