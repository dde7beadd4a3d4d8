"""Quality score over five dimensions, and the issues behind it.

Everything is arithmetic on the column facts (one row per column). Only the evidence samples go
back to the rows, and only for values already known to offend.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tersa.functions import names, numbers, text
from tersa.functions import vocabulary as V
from tersa.operators.analysis import Analysis, percentage, round2, wants_case_check
from tersa.operators.catalog import NUMBER, OTHER, TEXT
from tersa.operators.profile import _analysis

# Weight of each dimension in the overall score, in report order.
WEIGHTS = {
    "completeness": 0.30, "uniqueness": 0.15, "consistency": 0.20, "validity": 0.25,
    "integrity": 0.10,
}
# Score bands.
GREEN_FROM, AMBER_FROM = 85.0, 65.0

# Issue kinds in report order: kind -> (dimension, order of the dimension, order within a column).
ISSUE_KINDS = {
    "nulls": ("completeness", 1, 1),
    "duplicates": ("uniqueness", 2, 1),
    "whitespace": ("consistency", 3, 1),
    "case": ("consistency", 3, 2),
    "dates": ("validity", 4, 1),
    "numbers": ("validity", 4, 2),
    "percent_range": ("integrity", 5, 1),
    "negatives": ("integrity", 5, 2),
}


def is_date_column() -> Column:
    return (F.col("semantic_hint") == "date") | (F.col("inferred_type") == "datetime")


def is_quantity_column() -> Column:
    return (
        (F.col("inferred_type") == "numeric")
        | F.col("semantic_hint").isin("currency", "percentage")
        | names.has_word(F.col("column_name"), V.QUANTITY_WORDS)
    )


def is_percent_column() -> Column:
    """A percent sign anywhere in the data, or a percentage-like name."""
    return F.col("has_percent") | names.is_percent_name(F.col("column_name"))


def is_positive_column() -> Column:
    positive = (F.col("semantic_hint") == "currency") | names.has_word(
        F.col("column_name"), V.POSITIVE_WORDS
    )
    return positive & (F.col("semantic_hint") != "percentage")


def issue_counts(analysis: Analysis) -> DataFrame:
    """The facts plus one count per column-level issue kind."""
    variants = F.col("case_variants")
    percent = F.col("semantic_hint") == "percentage"

    def only(condition: Column, count: Column) -> Column:
        return F.when(condition, count).otherwise(F.lit(0)).cast("bigint")

    return analysis.checked_facts.withColumns({
        "count_nulls": F.col("nulls"),
        "count_whitespace": F.col("excess_space"),
        "count_case": only(wants_case_check(), F.greatest(variants, F.col("all_caps"))),
        "count_dates": only(is_date_column(), F.col("filled") - F.col("standard_dates")),
        "count_numbers": only(is_quantity_column(), F.col("dirty_numbers")),
        "count_percent_range": only(percent, F.col("negatives") + F.col("over_hundred")),
        "count_negatives": only(is_positive_column(), F.col("negatives")),
    })


def _severity(kind: Column, share: Column) -> Column:
    return (
        F.when(kind == "nulls", F.when(share > 50, "critical").when(share > 20, "high").otherwise("medium"))
        .when(kind == "duplicates", F.when(share > 5, "high").otherwise("medium"))
        .when(kind == "whitespace", "low")
        .when(kind.isin("case", "numbers"), "medium")
        .otherwise("high")
    )


def _action(kind: Column) -> Column:
    actions = {
        "nulls": "fill_missing", "duplicates": "remove_duplicates", "whitespace": "trim_text",
        "case": "normalize_case", "dates": "convert_datetime", "numbers": "convert_numeric",
        "percent_range": "clamp_range", "negatives": "clamp_range",
    }
    return F.element_at(F.create_map(*[F.lit(x) for kv in actions.items() for x in kv]), kind)


def _description() -> Column:
    """What was found, in the language of the report."""
    texts = {
        "nulls": "valores ausentes",
        "duplicates": "filas repetidas",
        "whitespace": "valores con espacios de más",
        "case": "valores con mayúsculas y minúsculas dispares",
        "dates": "fechas fuera del formato de la columna",
        "numbers": "celdas numéricas con símbolos, texto o marcas de ausencia",
        "percent_range": "porcentajes fuera de [0, 100]",
        "negatives": "negativos donde no caben",
    }
    labels = F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])
    return F.concat(
        F.coalesce(F.concat(F.col("column"), F.lit(": ")), F.lit("")),
        F.col("affected_rows").cast("string"), F.lit(" "), F.element_at(labels, F.col("kind")),
        F.lit(" ("), numbers.float_text(F.col("affected_percentage")), F.lit("%)"),
    )


def _issue_rows(analysis: Analysis) -> DataFrame:
    """(position, column, kind, affected_rows, rows, is_percent, numeric), one row per issue."""
    kinds = [k for k in ISSUE_KINDS if k != "duplicates"]
    entries = F.array(*[
        F.when(
            F.col(f"count_{k}") > 0,
            F.struct(F.lit(k).alias("kind"), F.col(f"count_{k}").alias("affected_rows")),
        )
        for k in kinds
    ])
    per_column = issue_counts(analysis).select(
        "position", F.col("column_name").alias("column"), "rows",
        is_percent_column().alias("is_percent"),
        (F.col("inferred_type") == "numeric").alias("is_numeric"),
        "semantic_hint", "standard_class", "all_caps",
        F.inline(F.array_compact(entries)),
    )
    whole = analysis.duplicates.where(F.col("duplicates_count") > 0).select(
        F.lit(-1).alias("position"), F.lit(None).cast("string").alias("column"),
        F.col("row_count").alias("rows"), F.lit(False).alias("is_percent"),
        F.lit(False).alias("is_numeric"), F.lit("unknown").alias("semantic_hint"),
        F.lit(0).alias("standard_class"), F.lit(0).cast("bigint").alias("all_caps"),
        F.lit("duplicates").alias("kind"), F.col("duplicates_count").alias("affected_rows"),
    )
    return per_column.unionByName(whole)


def _ordered(issues: DataFrame) -> DataFrame:
    """Number the issues in report order; there are at most eight per column of the table."""
    order = F.create_map(*[
        x for k, (_, dim, within) in ISSUE_KINDS.items()
        for x in (F.lit(k), F.struct(F.lit(dim).alias("d"), F.lit(within).alias("w")))
    ])
    dimension = F.create_map(*[F.lit(x) for k, v in ISSUE_KINDS.items() for x in (k, v[0])])
    place = F.element_at(order, F.col("kind"))
    window = Window.partitionBy(F.lit(0)).orderBy("d_order", "position", "w_order")
    return (
        issues.withColumns({
            "d_order": place["d"], "w_order": place["w"],
            "dimension": F.element_at(dimension, F.col("kind")),
        })
        .withColumn("issue_no", F.row_number().over(window).cast("bigint"))
    )


def quality_issues(
    source: DataFrame | Analysis, order_by: str | None = None, evidence: bool = True
) -> DataFrame:
    """One row per issue, in report order. ``evidence=False`` spares the second look at the rows."""
    analysis = _analysis(source, order_by)
    issues = _ordered(_issue_rows(analysis)).withColumn(
        "affected_percentage", percentage(F.col("affected_rows"), F.col("rows"))
    )
    if evidence:
        issues = issues.join(evidence_samples(analysis), ["position", "kind"], "left")
        constant = F.when(F.col("kind") == "nulls", F.array(F.lit(V.EMPTY_EVIDENCE))).when(
            F.col("kind") == "duplicates",
            F.array(F.concat(F.col("affected_rows").cast("string"), F.lit(" registros idénticos"))),
        )
        sample = F.coalesce(constant, F.col("evidence_sample"), F.array().cast("array<string>"))
        issues = issues.withColumn("evidence_sample", sample)
    kind = F.col("kind")
    columns = [
        "issue_no", "dimension", _severity(kind, F.col("affected_percentage")).alias("severity"),
        "column", "kind", _description().alias("description"), "affected_rows",
        "affected_percentage", _action(kind).alias("suggested_action"),
    ]
    return issues.select(*columns, *(["evidence_sample"] if evidence else []))


def _text_kinds() -> Column:
    """Issue kinds a text cell gives evidence for; needs the cell and the facts of its column."""
    number = F.col("number")
    caps = F.col("all_caps") == 0
    dirty = F.col("marker") | numbers.has_symbol(F.col("t")) | number.isNull()
    off_standard = ~F.col("date_class").eqNullSafe(F.col("standard_class"))
    tests = {
        "whitespace": text.has_excess_whitespace(F.col("text")),
        "case": (F.col("count_case") > 0) & (caps | text.is_all_caps(F.col("t"))),
        "dates": (F.col("count_dates") > 0) & off_standard,
        "numbers": (F.col("count_numbers") > 0) & dirty,
        **_range_tests(),
    }
    return F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))


def _range_tests() -> dict[str, Column]:
    number = F.col("number")
    return {
        "percent_range": (F.col("count_percent_range") > 0) & ((number < 0) | (number > 100)),
        "negatives": (F.col("count_negatives") > 0) & (number < 0),
    }


def evidence_samples(analysis: Analysis, k: int = 3) -> DataFrame:
    """(position, kind, evidence_sample): the first k offending cells of each issue, in row order.

    Text: the k first offending rows hold at most k distinct values, namely those seen first. So
    the value table yields the few candidates, and one scan finds their first rows. Typed columns
    only need comparisons, which run on the rows directly. Every ranking is cut to k rows per task
    before its shuffle. Spelling variants are shown once each.
    """
    counts = ["count_case", "count_dates", "count_numbers", "count_percent_range", "count_negatives"]
    facts = issue_counts(analysis).select("position", "standard_class", "all_caps", *counts)
    parts = []
    if analysis.has(TEXT, OTHER):
        parts.append(_text_evidence(analysis, facts, k))
    if analysis.has(NUMBER):
        tests = _range_tests()
        kinds = F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]))
        number = F.coalesce(F.col("whole").cast("double"), numbers.finite(F.col("number")))
        out_of_range = facts.where("count_percent_range + count_negatives > 0")
        parts.append(
            analysis.typed_rows().withColumn("number", number)
            .join(F.broadcast(out_of_range), "position")
            .select("row", "position", F.explode(kinds).alias("kind"), F.col("number").cast("string").alias("shown"))
        )
    found = reduce(DataFrame.unionByName, [_first_rows(p, k) for p in parts])
    listed = F.array_sort(F.collect_list(F.struct("rank", "shown")))
    return found.groupBy("position", "kind").agg(listed["shown"].alias("evidence_sample"))


def _first_rows(found: DataFrame, k: int) -> DataFrame:
    by_row = Window.partitionBy("position", "kind").orderBy("row", "shown")
    return found.withColumn("rank", F.row_number().over(by_row)).where(F.col("rank") <= k)


def _text_evidence(analysis: Analysis, facts: DataFrame, k: int) -> DataFrame:
    """(row, position, kind, shown): at least the first k offending rows of each issue.

    The candidates are broadcast: at most k per issue and column, a few fixed-width fields each
    (values are matched by hash and length, so that long texts stay where they are).
    """
    flagged = (
        analysis.text_cells.where(F.col("text").isNotNull())
        .join(F.broadcast(facts), "position")
        .withColumn("kind", F.explode(_text_kinds()))
        .select(
            "position", "kind", "text", "first", "n",
            ((F.col("kind") == "case") & (F.col("all_caps") == 0)).alias("once"),
        )
    )
    by_first = Window.partitionBy("position", "kind").orderBy("first", "n", "text")
    few = flagged.withColumn("rank", F.row_number().over(by_first)).where(F.col("rank") <= k)
    spellings = few.where("once").select(
        F.col("first").alias("row"), "position", "kind", F.col("text").alias("shown")
    )
    # With k candidates at hand, no later row can be among the first k. Scan order is not relied
    # upon here: it may differ between two passes over a shuffled table.
    issue = Window.partitionBy("position", "kind")
    enough = (F.count(F.lit(1)).over(issue) == k) & F.lit(analysis.order_by is not None)
    last = F.when(enough, F.max("first").over(issue))
    match = [F.xxhash64("text").alias("hash"), F.octet_length("text").alias("bytes")]
    candidates = few.where(~F.col("once")).select("position", *match, "kind", last.alias("last"))
    located = (
        analysis.text_rows().select("row", "position", "text", *match)
        .join(F.broadcast(candidates), ["position", "hash", "bytes"])
        .where(F.col("last").isNull() | (F.col("row") <= F.col("last")))
        .select("row", "position", "kind", F.col("text").alias("shown"))
    )
    top = _first_rows(located, k).drop("rank").unionByName(spellings)
    value = F.col("shown")
    shown = (
        F.when(F.col("kind").isin("percent_range", "negatives"), numbers.parse_number(value).cast("string"))
        .when(F.col("kind").isin("dates", "numbers"), text.strip(value))
        .otherwise(value)
    )
    return top.select("row", "position", "kind", shown.alias("shown"))


def _share_left(bad: Column, whole: Column) -> Column:
    """100 · (1 − bad / whole), not below 0; 100 for an empty table."""
    left = F.greatest(F.lit(0.0), F.lit(100.0) * (F.lit(1.0) - bad / whole))
    return F.when(whole > 0, round2(left)).otherwise(F.lit(100.0))


def dimension_totals(analysis: Analysis) -> DataFrame:
    """One row: offending cells and issue count per dimension, with row and cell totals."""
    def cells(*kinds: str) -> Column:
        return sum((F.coalesce(F.sum(f"count_{k}"), F.lit(0)) for k in kinds), F.lit(0))

    def issues(*kinds: str) -> Column:
        return sum((F.count_if(F.col(f"count_{k}") > 0) for k in kinds), F.lit(0))

    dup = analysis.duplicates.select(F.struct("row_count", "duplicates_count")).scalar()
    totals = issue_counts(analysis).agg(
        cells("nulls").alias("bad_completeness"),
        cells("whitespace", "case").alias("bad_consistency"),
        cells("dates", "numbers").alias("bad_validity"),
        cells("percent_range", "negatives").alias("bad_integrity"),
        issues("nulls").alias("issues_completeness"),
        issues("whitespace", "case").alias("issues_consistency"),
        issues("dates", "numbers").alias("issues_validity"),
        issues("percent_range", "negatives").alias("issues_integrity"),
    ).withColumn("dup", dup)
    return totals.select(
        "*",
        F.col("dup.row_count").alias("rows"),
        (F.col("dup.row_count") * len(analysis.columns)).alias("cells"),
        F.col("dup.duplicates_count").alias("bad_uniqueness"),
        F.when(F.col("dup.duplicates_count") > 0, 1).otherwise(0).cast("bigint").alias("issues_uniqueness"),
    ).drop("dup")


def _scores(analysis: Analysis) -> DataFrame:
    """One row: totals and the score of each dimension."""
    whole = {"completeness": "cells", "uniqueness": "rows", "consistency": "cells",
             "validity": "cells", "integrity": "rows"}
    return dimension_totals(analysis).withColumns({
        f"score_{d}": _share_left(F.col(f"bad_{d}"), F.col(whole[d])) for d in WEIGHTS
    })


def quality_scores(source: DataFrame | Analysis) -> DataFrame:
    """One row per dimension: score, weight, number of issues, summary."""
    analysis = _analysis(source)
    labels = {
        "completeness": ("Datos completos", "celdas vacías"),
        "uniqueness": ("Registros únicos", "filas repetidas"),
        "consistency": ("Formato homogéneo", "desvíos de formato"),
        "validity": ("Formatos válidos", "celdas no válidas"),
        "integrity": ("Reglas de negocio", "valores fuera de rango"),
    }
    rows = F.array(*[
        F.struct(
            F.lit(d).alias("dimension"),
            F.col(f"score_{d}").alias("score"),
            F.lit(w).alias("weight"),
            F.col(f"issues_{d}").alias("issues_count"),
            F.concat(
                F.lit(f"{labels[d][0]}: "), numbers.float_text(F.col(f"score_{d}")), F.lit("% ("),
                F.col(f"bad_{d}").cast("string"), F.lit(f" {labels[d][1]})"),
            ).alias("summary"),
        )
        for d, w in WEIGHTS.items()
    ])
    return _scores(analysis).select(F.inline(rows))


def score_band(score: Column) -> Column:
    return F.when(score >= GREEN_FROM, "green").when(score >= AMBER_FROM, "amber").otherwise("red")


def overall_score() -> Column:
    weighted = sum(
        (F.lit(WEIGHTS[d]) * F.col(f"score_{d}")
         for d in ("completeness", "validity", "consistency", "uniqueness", "integrity")),
        F.lit(0.0),
    )
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), weighted))
    return numbers.round_even(bounded, 1)


def quality_overall(source: DataFrame | Analysis) -> DataFrame:
    """One row: overall score, band, number of issues, explanation."""
    analysis = _analysis(source)
    issues = sum((F.col(f"issues_{d}") for d in WEIGHTS), F.lit(0)).cast("bigint")
    scored = _scores(analysis).select(
        overall_score().alias("overall_score"), issues.alias("issues_count"),
        "score_completeness", "score_validity",
    )
    return scored.select(
        "overall_score",
        score_band(F.col("overall_score")).alias("band"),
        "issues_count",
        F.concat(
            F.lit("Calidad "), numbers.float_text(F.col("overall_score")), F.lit("/100 con "),
            F.col("issues_count").cast("string"), F.lit(" problemas; completos "),
            numbers.float_text(F.col("score_completeness")), F.lit("%, válidos "),
            numbers.float_text(F.col("score_validity")), F.lit("%"),
        ).alias("explanation"),
    )


def before_after(
    before: DataFrame | Analysis, after: DataFrame | Analysis, applied_steps: int | None = None,
    seconds: float | None = None,
) -> DataFrame:
    """One row: sizes and overall score of a table before and after cleaning, steps applied, seconds taken."""
    first, second = _analysis(before), _analysis(after)

    def side(analysis: Analysis) -> DataFrame:
        return _scores(analysis).select(
            F.struct(F.col("rows"), overall_score().alias("score")).alias("s")
        )

    return side(first).select(
        F.col("s").alias("b"), side(second).scalar().alias("a")
    ).select(
        F.col("b.rows").alias("rows_before"), F.col("a.rows").alias("rows_after"),
        F.lit(len(first.columns)).cast("bigint").alias("columns_before"),
        F.lit(len(second.columns)).cast("bigint").alias("columns_after"),
        F.col("b.score").alias("score_before"), F.col("a.score").alias("score_after"),
        F.lit(applied_steps).cast("bigint").alias("applied_steps"),
        F.lit(seconds).cast("double").alias("execution_seconds"),
    )
