"""Reading delimited files and tables; writing clean tables."""

from __future__ import annotations

import csv
import io
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tersa.functions import vocabulary as V
from tersa.functions.numbers import PLAIN_FLOAT, PLAIN_INTEGER

DELIMITERS = [",", ";", "\t", "|"]
_SNIFF_CHARS = 4096
_CORRUPT = "_corrupt_record"


def sniff_delimiter(sample: str) -> str:
    """Guess the delimiter from the first characters of a file; comma if nothing fits."""
    try:
        return csv.Sniffer().sniff(sample[:_SNIFF_CHARS], delimiters="".join(DELIMITERS)).delimiter
    except csv.Error:
        return ","


def _header_sample(spark: SparkSession, path: str) -> str:
    lines = spark.read.text(path).limit(512)
    start = lines.select(F.substring("value", 1, _SNIFF_CHARS).alias("value"))
    return "\n".join(row.value for row in start.collect())


def _column_names(header: list[str]) -> list[str]:
    names, seen = [], {}
    for i, raw in enumerate(header):
        name = raw.lstrip("﻿") or f"Unnamed: {i}"
        copies = seen.get(name, 0)
        seen[name] = copies + 1
        names.append(f"{name}.{copies}" if copies else name)
    return names


def scan_csv(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    columns: list[str] | None = None,
    infer_numbers: bool = True,
    multiline: bool = False,
) -> DataFrame:
    """Scan delimited UTF-8 text with a header row.

    Rows with too many fields are dropped, short rows are padded with NULL, the reader's NA tokens
    become NULL. With ``infer_numbers`` (one extra aggregate over the file) a column made only of
    plain numbers is typed; every other column stays text. Files stay splittable unless
    ``multiline`` is asked for.
    """
    sep = sep or sniff_delimiter(_header_sample(spark, path))
    if columns is None:
        # Blank lines above the header are skipped, as the reader does.
        first_line = spark.read.text(path).where(F.trim("value") != "").first()
        header = next(csv.reader(io.StringIO(first_line.value), delimiter=sep), []) if first_line else []
        columns = _column_names(header)
    if not columns:
        raise ValueError("NO_COLUMNS_FOUND: the file has no header row")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, _CORRUPT]])
    raw = (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _CORRUPT)
        # A pruned parse would not see that a record has too many fields.
        .option("columnPruning", False)
        .option("multiLine", multiline)
        .csv(path)
    )
    rows = drop_overlong_rows(raw, sep, len(columns))
    clean = rows.select(*[reader_null(c).alias(c) for c in columns])
    return type_plain_numbers(clean) if infer_numbers else clean


def drop_overlong_rows(raw: DataFrame, sep: str, width: int) -> DataFrame:
    """Drop records with more fields than the header; separators inside quotes do not count."""
    record = F.col(_CORRUPT)
    unquoted = F.regexp_replace(record, r'"[^"]*+(?:""[^"]*+)*+"', "")
    fields = F.size(F.split(unquoted, re.escape(sep), -1))
    # Always true; a count alone would otherwise ask for the corrupt record only, which Spark refuses.
    asked = F.coalesce(F.length(F.col(f"`{raw.columns[0]}`")) >= 0, F.lit(True))
    return raw.where((record.isNull() & asked) | (fields <= width)).drop(_CORRUPT)


def reader_null(name: str):
    c = F.col(f"`{name}`")
    return F.when(~c.isin(V.READER_NA_TOKENS), c)


def apply_reader_nulls(df: DataFrame) -> DataFrame:
    """NA tokens -> NULL in every text column, in one projection."""
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.select(
        *[reader_null(c).alias(c) if c in text else F.col(f"`{c}`") for c in df.columns]
    )


def type_plain_numbers(df: DataFrame) -> DataFrame:
    """Type text columns that hold plain numbers only: whole numbers as bigint, others as double.

    Whole numbers that do not all fit 64 bits (long codes) stay text. One map-side aggregate with
    three flags per column decides for all of them.
    """
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    flags = []
    for i, name in enumerate(text):
        c = F.col(f"`{name}`")
        flags.append(F.every(c.rlike(PLAIN_FLOAT)).alias(f"f{i}"))
        flags.append(F.every(F.coalesce(c.rlike(PLAIN_INTEGER), F.lit(False))).alias(f"i{i}"))
        flags.append(F.some(c.rlike(PLAIN_INTEGER) & F.trim(c).try_cast("bigint").isNull()).alias(f"l{i}"))
    found = df.agg(*flags).first()
    kinds = {}
    for i, name in enumerate(text):
        if found[f"f{i}"]:
            if found[f"i{i}"] and found[f"l{i}"]:
                continue
            kinds[name] = "bigint" if found[f"i{i}"] else "double"
    return df.select(
        *[
            F.trim(F.col(f"`{c}`")).try_cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def _resolves(df: DataFrame, *names: str) -> bool:
    try:
        return "_metadata" not in df.columns and bool(df.select(*names).schema)
    except AnalysisException:
        return False


def row_order(df: DataFrame) -> Column:
    """A column that orders rows as the files hold them: by file name, then by place in the file.

    The order does not depend on how files are split, packed into partitions or scheduled. Parquet knows each row's index; in
    other formats it is the split's offset and the row's turn in it. Tables that do not come straight from files (after a join of
    files, a union, a grouping, or from a view) have the order of the scan.
    """
    turn = F.monotonically_increasing_id()
    path = F.col("_metadata.file_path") if _resolves(df, "_metadata.file_path") else None
    if path is not None and _resolves(df, "_metadata.row_index"):
        return F.struct(path.alias("file"), F.col("_metadata.row_index").alias("row"))
    if path is not None and _resolves(df, "_metadata.file_block_start"):
        return F.struct(path.alias("file"), F.col("_metadata.file_block_start").alias("block"), turn.alias("row"))
    return turn


def row_number_in_files(df: DataFrame) -> Column:
    """One bigint for each row of Parquet files, in the order of the rows of a file; files are ordered by a hash of their names.

    It is as stable as ``row_order`` and cheap to aggregate. Other tables have the order of the scan.
    """
    if not _resolves(df, "_metadata.file_name", "_metadata.row_index"):
        return F.monotonically_increasing_id()
    file = F.xxhash64("_metadata.file_name").bitwiseAND(F.lit((1 << 23) - 1))
    return F.shiftleft(file, 40) + F.col("_metadata.row_index")


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.table(name)


def write_clean(
    df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite",
    partition_by: list[str] | None = None,
) -> None:
    """Write the clean table as ``parquet`` or ``csv`` (UTF-8, header, ISO dates)."""
    if format not in ("csv", "parquet"):
        raise ValueError(f"INVALID_PARAMETER: unsupported format '{format}'")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format == "csv":
        writer.option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)
    else:
        writer.parquet(path)
