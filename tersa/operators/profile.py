"""Profiling: one row per column, and one row for the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersa.functions import numbers
from tersa.operators.analysis import Analysis, percentage, round2
from tersa.operators.catalog import DATE, NUMBER


def _column_warnings() -> Column:
    rows, unique = F.col("rows"), F.col("unique_count")
    null_share = percentage(F.col("nulls"), rows)
    return F.array_compact(F.array(
        F.when(
            null_share > 20.0,
            F.concat(F.lit("Muchos nulos: "), numbers.float_text(null_share), F.lit("%")),
        ),
        F.when((unique == 1) & (rows > 1), F.lit("Columna constante")),
        F.when(
            (F.col("inferred_type") == "text") & (unique == rows) & (rows > 1),
            F.lit("Cardinalidad máxima: ningún texto se repite"),
        ),
    ))


def profile(source: DataFrame | Analysis, order_by: str | None = None, approx: bool = False) -> DataFrame:
    """One row per column: type, hint, nulls, distinct values, sample, statistics, warnings.

    ``estimated``: whether unique_count, median and std (and what rests on unique_count: the types
    "categorical" and "text", two of the warnings) come from sketches, as they do with ``approx``.
    """
    analysis = _analysis(source, order_by, approx)
    facts = analysis.facts.drop("std", "median")
    if analysis.has(NUMBER, DATE) and not analysis.approx:
        facts = facts.join(analysis.unique_counts(), "position", "left").withColumn(
            "unique_count", F.coalesce("exact_count", "unique_count")
        )
    joined = (
        facts.join(analysis.number_stats(), "position", "left")
        .join(analysis.samples(), "position", "left")
    )
    return profile_rows(joined, analysis.approx)


def profile_rows(facts: DataFrame, estimated: bool) -> DataFrame:
    """The profile's columns from classified facts with samples and statistics."""
    numeric = F.col("inferred_type") == "numeric"
    return facts.select(
        "position",
        "column_name",
        "inferred_type",
        "semantic_hint",
        F.col("nulls").alias("null_count"),
        percentage(F.col("nulls"), F.col("rows")).alias("null_percentage"),
        "unique_count",
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        F.when(numeric, F.col("lo")).alias("min_value"),
        F.when(numeric, F.col("hi")).alias("max_value"),
        round2(F.col("mean")).alias("mean"),
        round2(F.col("median")).alias("median"),
        round2(F.col("std")).alias("std"),
        _column_warnings().alias("warnings"),
        F.lit(estimated).alias("estimated"),
    )


def profile_report(source: DataFrame | Analysis, order_by: str | None = None) -> DataFrame:
    """One row: sizes, repeated rows, estimated text size in bytes, table-wide warnings."""
    analysis = _analysis(source, order_by)
    size = analysis.facts.agg(F.sum("text_bytes")).scalar()
    dup, share = F.col("duplicates_count"), F.col("duplicates_percentage")
    notice = F.concat(
        dup.cast("string"), F.lit(" fila(s) repetidas ("), numbers.float_text(share), F.lit("%)")
    )
    return analysis.duplicates.select(
        "row_count",
        F.lit(len(analysis.columns)).cast("bigint").alias("column_count"),
        "duplicates_count",
        "duplicates_percentage",
        F.coalesce(size, F.lit(0)).cast("bigint").alias("memory_estimate_bytes"),
        F.array_compact(F.array(F.when(dup > 0, notice))).alias("global_warnings"),
    )


def _analysis(source: DataFrame | Analysis, order_by: str | None = None, approx: bool = False) -> Analysis:
    return source if isinstance(source, Analysis) else Analysis(source, order_by, approx=approx)
