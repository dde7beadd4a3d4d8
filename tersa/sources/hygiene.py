"""Ingest hygiene: empty rows, validation, metadata, table fingerprint."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersa.functions import vocabulary as V
from tersa.functions.text import strip

# Sizes above which ingest warns.
MAX_RECOMMENDED_ROWS = 100_000
MAX_RECOMMENDED_COLUMNS = 50


def is_empty_row(df: DataFrame) -> Column:
    """True where every column is NULL or holds nothing but an empty-row token."""
    def empty(name: str) -> Column:
        c = F.col(f"`{name}`")
        return c.isNull() | strip(c.cast("string")).isin(V.EMPTY_ROW_TOKENS)

    return reduce(and_, [empty(c) for c in df.columns])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.where(~is_empty_row(df))


def empty_row_counts(df: DataFrame) -> list[Column]:
    """Aggregates: rows read, rows purged, rows kept."""
    empty = is_empty_row(df)
    return [
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(empty).alias("rows_purged"),
        F.count_if(~empty).alias("rows_kept"),
    ]


def count_empty_rows(df: DataFrame) -> DataFrame:
    """One row: rows read, rows purged, rows kept."""
    return df.agg(*empty_row_counts(df))


def validate_ingest(
    df: DataFrame,
    max_rows: int = MAX_RECOMMENDED_ROWS,
    max_columns: int = MAX_RECOMMENDED_COLUMNS,
) -> DataFrame:
    """One row per broken rule: level (error / warning), code, observed value, limit.

    The limits only warn; there is no upper cap on what is processed.
    """
    rows, columns = F.col("rows"), F.lit(len(df.columns)).cast("bigint")

    def finding(level: str, code: str, value: Column, limit: int, broken: Column) -> Column:
        row = F.struct(
            F.lit(level).alias("level"), F.lit(code).alias("code"),
            value.alias("value"), F.lit(limit).cast("bigint").alias("limit"),
        )
        return F.when(broken, row)

    findings = F.array(
        finding("error", "NO_ROWS_FOUND", rows, 1, rows == 0),
        finding("error", "NO_COLUMNS_FOUND", columns, 1, columns == 0),
        finding("warning", "MANY_ROWS", rows, max_rows, rows > max_rows),
        finding("warning", "MANY_COLUMNS", columns, max_columns, columns > max_columns),
    )
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.inline(F.array_compact(findings)))


def dataset_metadata(
    df: DataFrame,
    name: str = "",
    max_rows: int = MAX_RECOMMENDED_ROWS,
    max_columns: int = MAX_RECOMMENDED_COLUMNS,
) -> DataFrame:
    """One row: name, row and column counts, column names, warning codes."""
    rows = F.col("row_count")
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("dataset"),
        rows,
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.array_compact(
            F.array(
                F.when(rows > max_rows, F.lit("MANY_ROWS")),
                F.when(F.lit(len(df.columns) > max_columns), F.lit("MANY_COLUMNS")),
            )
        ).alias("warnings"),
    )


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of a row. ``xxhash64`` skips NULLs, so the NULL pattern is hashed as well;
    without it ('a', NULL) and (NULL, 'a') would collide."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    return F.xxhash64(*[x for c in cols for x in (c, c.isNull())])


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive table hash: equal multisets of rows give equal fingerprints.

    Counts, xor and an overflow-free sum are all combined map-side; one row per task is shuffled.
    """
    return df.select(row_hash(df).alias("h")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.bit_xor("h").alias("hash_xor"),
        F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("hash_sum"),
    )
