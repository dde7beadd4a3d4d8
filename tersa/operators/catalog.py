"""The closed catalog of cleaning operations, and the registry users may extend.

A row operation is a list of stages, each ``Column -> Column``. Stages of one step must run in
successive projections (a later stage refers to the earlier result more than once); steps on
different columns share projections. ``plans.execute`` does that fusing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tersa.functions import dates, numbers, text
from tersa.functions import vocabulary as V
from tersa.operators.selection import frequent_values, grouped_medians, most_frequent
from tersa.sources.files import row_order
from tersa.sources.hygiene import row_hash
from tersa.sources.local import local_frame

Stage = Callable[[Column], Column]
SMALL_MAPPING = 64
BROADCAST_MAPPING = 100_000

TEXT, NUMBER, DATE, OTHER = "text", "number", "date", "other"


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATE
    return NUMBER if isinstance(data_type, T.NumericType) else OTHER


def column_kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema}


@dataclass(frozen=True)
class Operation:
    """One catalog entry.

    ``shape`` is ``row`` (stages over one column), ``statistic`` (stages that need an aggregate of
    the current column first), ``frame`` (rows are removed) or ``schema`` (rename, drop).
    """

    name: str
    description: str
    risk: str
    shape: str
    check: Callable[[dict[str, str], str | None, dict], None]
    stages: Callable[[str, dict], list[Stage]] | None = None
    result_kind: Callable[[str, dict], str] = field(default=lambda kind, params: kind)
    changed: Callable[[Column, Column, str, dict], Column] | None = None


# --- parameter checks: all of them run before any Spark job ------------------------------------


def _fail(code: str, message: str) -> None:
    raise ValueError(f"{code}: {message}")


def _need_column(kinds: dict[str, str], column: str | None) -> None:
    if not column or column not in kinds:
        _fail("INVALID_COLUMN", f"column '{column}' does not exist")


def _check_column(kinds, column, params):
    _need_column(kinds, column)


def _check_case(kinds, column, params):
    _need_column(kinds, column)
    if params.get("mode", "title") not in ("title", "lower", "upper"):
        _fail("INVALID_PARAMETER", f"unsupported mode '{params.get('mode')}'")


def _check_mapping(kinds, column, params):
    _need_column(kinds, column)
    if not isinstance(params.get("mappings"), dict) or not params["mappings"]:
        _fail("INVALID_PARAMETER", "'mappings' must be a non-empty dictionary")


def _check_datetime(kinds, column, params):
    _need_column(kinds, column)
    dates.java_pattern(params.get("target_format", "%Y-%m-%d"))


def _check_round(kinds, column, params):
    _need_column(kinds, column)
    decimals = params.get("decimals", 2)
    if not isinstance(decimals, int) or decimals < 0:
        _fail("INVALID_PARAMETER", "'decimals' must be a whole number >= 0")


def _check_fill(kinds, column, params):
    _need_column(kinds, column)
    strategy = params.get("strategy", "constant")
    if strategy not in ("constant", "mean", "median", "mode"):
        _fail("INVALID_PARAMETER", f"unsupported strategy '{strategy}'")
    if strategy in ("mean", "median") and kinds[column] not in (TEXT, NUMBER):
        _fail("INVALID_PARAMETER", f"'{column}' has no {strategy}")
    if strategy == "constant" and kinds[column] == NUMBER and not params.get("as_text"):
        try:
            float(params.get("value", V.DEFAULT_FILL))
        except (TypeError, ValueError):
            _fail("INVALID_PARAMETER", f"'{params.get('value')}' does not fit numeric '{column}'")


def _check_dedup(kinds, column, params):
    for name in params.get("subset_columns") or []:
        _need_column(kinds, name)


def _check_rename(kinds, column, params):
    _need_column(kinds, column)
    new_name = params.get("new_name")
    if not new_name or not isinstance(new_name, str):
        _fail("INVALID_PARAMETER", "'new_name' must be a non-empty text")
    if new_name != column and new_name in kinds:
        _fail("INVALID_PARAMETER", f"column '{new_name}' already exists")


# --- stages ------------------------------------------------------------------------------------


def _trim_stages(kind, params):
    return [text.collapse_spaces] if kind == TEXT else []


def _case_stages(kind, params):
    if kind != TEXT:
        return []
    mode = params.get("mode", "title")
    stages = {"title": [text.strip, text.title_stripped], "lower": [F.lower], "upper": [F.upper]}
    return stages[mode]


def _category_stages(kind, params):
    return [lambda c: text.map_values(c.cast("string"), params["mappings"])]


def _datetime_stages(kind, params):
    target = params.get("target_format", "%Y-%m-%d")
    if kind == DATE:
        return [lambda c: dates.strftime(c, target)]
    read_as = "timestamp" if dates.wants_time(target) else "date"
    return [
        lambda c: text.strip(c.cast("string")),
        lambda c: dates.read_stripped(c, read_as, bool(params.get("any_year"))),
        lambda c: dates.strftime(c, target),
    ]


def _numeric_stages(kind, params):
    if kind == NUMBER:
        return [lambda c: numbers.finite(c.cast("double"))]
    strict = params.get("strict_currency", True)
    return [
        lambda c: numbers.bare_number_text(c.cast("string"), strict),
        numbers.number_from_bare,
        numbers.finite,
    ]


def _coerced(kind: str) -> Stage:
    if kind == NUMBER:
        return lambda c: c.cast("double")
    return lambda c: numbers.coerce_number(c.cast("string"))


def _round_stages(kind, params):
    return [lambda c: numbers.round_even(_coerced(kind)(c), params.get("decimals", 2))]


def _clamp_stages(kind, params):
    low, high = params.get("min_value"), params.get("max_value")
    bound = lambda c: numbers.clamp(c, low, high)
    return [_coerced(kind), bound]


def _present(kind: str) -> Stage:
    """The value, or NULL for blank text and NaN."""
    if kind == TEXT:
        return text.blank_to_null
    return (lambda c: F.when(~F.isnan(c.cast("double")), c)) if kind == NUMBER else (lambda c: c)


def _fill_stages(kind, params):
    """``__fill__`` carries the statistic as a column (a scalar subquery) for the other strategies."""
    fill = params.get("__fill__")
    if fill is None and "fitted" in params:
        fill = F.lit(params["fitted"]).cast(params["fitted_type"])
    if fill is None:
        value = params.get("value", V.DEFAULT_FILL)
        if _fills_as_text(kind, params):
            return [lambda c: F.coalesce(_present(kind)(c).cast("string"), F.lit(str(value)))]
        fill = F.lit(float(value)) if kind == NUMBER else F.lit(str(value))
    return [lambda c: F.coalesce(_present(kind)(c), fill)]


def fill_statistics(
    df: DataFrame, wanted: list[tuple[str, str, dict]], prefix: str = "__statistics"
) -> tuple[dict[str, Column], list[Column]]:
    """The statistics as columns to add to the table, and the filling value of each (column, kind, parameters).

    All means are one scalar subquery, all medians another, all most frequent texts a third, whatever
    the number of columns. Each is a column of its own, named with ``prefix``, that the fills read fields of:
    referred to by each fill, Spark would run it once for each.
    """
    extra: dict[str, Column] = {}

    def attached(name: str, value: Column) -> Column:
        extra[f"{prefix}_{name}"] = value
        return F.col(f"{prefix}_{name}")

    def picked(rows: DataFrame, value: str, slots: list[int], kind: str) -> Column:
        fields = [F.max(F.when(F.col("k") == i, F.col(value))).cast(kind).alias(f"s{i}") for i in slots]
        return rows.agg(*fields).select(F.struct(*[f"s{i}" for i in slots])).scalar()

    def stacked(slots: list[int], value: Callable[[int], Column], kind: str) -> DataFrame:
        parts = [x for i in slots for x in (F.lit(i), value(i).cast(kind))]
        return df.select(F.stack(F.lit(len(slots)), *parts).alias("k", "v"))

    def number(i: int) -> Column:
        column, kind, _ = wanted[i]
        return numbers.finite(_coerced(kind)(F.col(f"`{column}`")))

    def present(i: int) -> Column:
        column, kind, _ = wanted[i]
        return _present(kind)(F.col(f"`{column}`"))

    slots: dict[str, list[int]] = {"mean": [], "median": [], "mode": []}
    for i, (_, _, params) in enumerate(wanted):
        slots[params["strategy"]].append(i)
    found: dict[int, Column] = {}
    if slots["mean"]:
        means = stacked(slots["mean"], number, "double").groupBy("k").agg(F.avg("v").alias("mean"))
        row = attached("mean", picked(means, "mean", slots["mean"], "double"))
        found |= {i: row[f"s{i}"] for i in slots["mean"]}
    if slots["median"]:
        medians = grouped_medians(stacked(slots["median"], number, "double"))
        row = attached("median", picked(medians, "median", slots["median"], "double"))
        found |= {i: row[f"s{i}"] for i in slots["median"]}
    words = [i for i in slots["mode"] if wanted[i][1] == TEXT]
    if words:
        top = frequent_values(stacked(words, present, "string"), 1)
        row = attached("mode", picked(top, "v", words, "string"))
        found |= {i: row[f"s{i}"] for i in words}
    for i in set(slots["mode"]) - set(words):  # other types keep theirs: one subquery a column
        found[i] = attached(f"mode_{i}", most_frequent(df, present(i)).scalar())
    values = []
    for i, (_, kind, params) in enumerate(wanted):
        value = found[i]
        if params["strategy"] == "mode":
            default = F.lit(str(params.get("value", V.DEFAULT_FILL))) if kind == TEXT else F.lit(None)
            values.append(F.coalesce(value, default))
        else:
            values.append(numbers.float_text(value) if kind == TEXT else value)
    return extra, values


# --- what counts as a changed cell -------------------------------------------------------------


def _value_changed(before: Column, after: Column, kind: str, params: dict) -> Column:
    return ~before.eqNullSafe(after)


def _number_changed(before: Column, after: Column, kind: str, params: dict) -> Column:
    if params.get("compare") == "text":
        return ~before.cast("string").eqNullSafe(numbers.float_text(after))
    read = before.cast("double") if kind == NUMBER else before.cast("string").try_cast("double")
    return ~read.eqNullSafe(after) | (before.isNotNull() & after.isNull())


def _text_changed(before: Column, after: Column, kind: str, params: dict) -> Column:
    return ~text.strip(before.cast("string")).eqNullSafe(after)


def _label_changed(before: Column, after: Column, kind: str, params: dict) -> Column:
    return ~before.cast("string").eqNullSafe(after)


def _parsed_changed(before: Column, after: Column, kind: str, params: dict) -> Column:
    read = before.cast("double") if kind == NUMBER else numbers.parse_number(before.cast("string"))
    return ~read.eqNullSafe(after)


def _coerced_changed(before: Column, after: Column, kind: str, params: dict) -> Column:
    return ~_coerced(kind)(before).eqNullSafe(after)


def _was_missing(before: Column, after: Column, kind: str, params: dict) -> Column:
    return _present(kind)(before).isNull()


def _every_row(before: Column, after: Column, kind: str, params: dict) -> Column:
    return F.lit(True)


_NUMERIC = lambda kind, params: NUMBER
_TEXTUAL = lambda kind, params: TEXT


def _fills_as_text(kind, params) -> bool:
    """A constant turns dates and other types into text, and numbers if asked to."""
    constant = params.get("strategy", "constant") == "constant"
    return constant and (kind in (DATE, OTHER) or (kind == NUMBER and bool(params.get("as_text"))))


def _fill_kind(kind, params):
    return TEXT if _fills_as_text(kind, params) else kind


_CATALOG: dict[str, Operation] = {
    op.name: op
    for op in [
        Operation("trim_text", "Collapse runs of white space and strip both ends", "low", "row",
                  _check_column, _trim_stages, changed=_value_changed),
        Operation("normalize_case", "Title case that keeps acronyms, lower or upper case", "low",
                  "row", _check_case, _case_stages, changed=_value_changed),
        Operation("normalize_category", "Replace values by their canonical label", "low", "row",
                  _check_mapping, _category_stages, _TEXTUAL, _label_changed),
        Operation("convert_datetime", "Read mixed date formats, write one", "medium", "row",
                  _check_datetime, _datetime_stages, _TEXTUAL, _text_changed),
        Operation("convert_numeric", "Read number text with symbols and separators", "medium",
                  "row", _check_column, _numeric_stages, _NUMERIC, _number_changed),
        Operation("round_numeric", "Round half to even", "low", "row", _check_round,
                  _round_stages, _NUMERIC, _coerced_changed),
        Operation("clamp_range", "Bring numbers into a range", "medium", "row", _check_column,
                  _clamp_stages, _NUMERIC, _parsed_changed),
        Operation("fill_missing", "Fill by constant, mean, median or mode", "medium", "row",
                  _check_fill, _fill_stages, _fill_kind, _was_missing),
        Operation("remove_duplicates", "Drop repeated rows, whole or by key", "high", "frame",
                  _check_dedup),
        Operation("rename_column", "Rename a column", "low", "schema", _check_rename,
                  changed=_every_row),
        Operation("drop_column", "Drop a column", "high", "schema", _check_column,
                  changed=_every_row),
    ]
}
_REGISTRY: dict[str, Operation] = dict(_CATALOG)


def get_operation(name: str) -> Operation:
    if name not in _REGISTRY:
        _fail("UNREGISTERED_OPERATION", f"'{name}' is not one of {sorted(_REGISTRY)}")
    return _REGISTRY[name]


def list_operations() -> dict[str, str]:
    return {name: op.description for name, op in _REGISTRY.items()}


def register_operation(
    name: str, stage: Stage, description: str = "", risk: str = "medium",
    result_kind: str | None = None,
) -> None:
    """Add a user-defined row operation given as ``Column -> Column``."""
    if name in _CATALOG:
        _fail("INVALID_PARAMETER", f"'{name}' is a built-in operation")
    _REGISTRY[name] = Operation(
        name, description, risk, "row", _check_column, lambda kind, params: [stage],
        (lambda kind, params: result_kind) if result_kind else (lambda kind, params: kind),
        _value_changed,
    )


def unregister_operation(name: str) -> None:
    if name not in _CATALOG:
        _REGISTRY.pop(name, None)


# --- frame operations --------------------------------------------------------------------------


def remove_duplicates(
    df: DataFrame, subset_columns: list[str] | None = None, order_by: str | None = None
) -> DataFrame:
    """Drop repeated rows; with a key, keep the first row per key.

    "First" follows ``order_by``, else the order of the rows in the table's files; a row hash settles ties, so the
    result does not depend on partitioning. The filter on ``row_number`` makes Spark keep one row per key
    and task before the shuffle, so a hot key costs one row per task.
    """
    if not subset_columns:
        return df.dropDuplicates()
    order = F.col(f"`{order_by}`") if order_by else F.col("__row")
    ranked = df if order_by else df.withColumn("__row", row_order(df))
    ranked = ranked.withColumn("__tie", row_hash(df))
    keys = [F.col(f"`{c}`") for c in subset_columns]
    window = Window.partitionBy(*keys).orderBy(order.asc_nulls_last(), "__tie")
    first = ranked.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") == 1)
    return first.select(*[F.col(f"`{c}`") for c in df.columns])


def map_large_category(
    df: DataFrame, column: str, mappings: dict[str, str], keep_as: str | None = None
) -> DataFrame:
    """Replacement from a large dictionary by a join; broadcast only up to a fixed entry count.

    ``keep_as`` names an extra column with the value before.
    """
    spark = df.sparkSession
    table = local_frame(spark, list(mappings.items()), "__from string, __to string")
    table = table.withColumn("__known", F.lit(True))
    if len(mappings) <= BROADCAST_MAPPING:
        table = F.broadcast(table)
    c = F.col(f"`{column}`")
    joined = df.join(table, c.cast("string") == F.col("__from"), "left")
    label = F.when(F.col("__known"), F.col("__to")).otherwise(c.cast("string"))
    before = [c.alias(keep_as)] if keep_as else []
    return joined.select(
        *[label.alias(n) if n == column else F.col(f"`{n}`") for n in df.columns], *before
    )


# --- one operation on its own ------------------------------------------------------------------


def apply_operation(
    df: DataFrame, operation: str, column: str | None = None, order_by: str | None = None,
    **params,
) -> DataFrame:
    """Apply one catalog operation. Wrong parameters raise ``ValueError`` before any job."""
    op = get_operation(operation)
    kinds = column_kinds(df)
    op.check(kinds, column, params)
    if operation == "remove_duplicates":
        return remove_duplicates(df, params.get("subset_columns"), order_by)
    if operation == "rename_column":
        return df.withColumnRenamed(column, params["new_name"])
    if operation == "drop_column":
        return df.drop(column)
    if operation == "normalize_category" and len(params["mappings"]) > SMALL_MAPPING:
        return map_large_category(df, column, params["mappings"])
    names = df.columns
    if needs_statistic(operation, params):
        extra, (fill,) = fill_statistics(df, [(column, kinds[column], params)])
        df = df.withColumns(extra)
        params = {**params, "__fill__": fill}
    for stage in op.stages(kinds[column], params):
        df = df.withColumn(column, stage(F.col(f"`{column}`")))
    return df.select(*[F.col(f"`{c}`") for c in names])


def needs_statistic(operation: str, params: dict) -> bool:
    """Whether a step reads the whole table first; one that was fitted carries its statistic."""
    return operation == "fill_missing" and params.get("strategy", "constant") != "constant" and "fitted" not in params
