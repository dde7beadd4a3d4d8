"""The registered queries: name -> callable, and name -> equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersa.functions import dates, masks, names, numbers, text
from tersa.functions import vocabulary as V
from tersa.operators import kpi, spelling
from tersa.operators.analysis import Analysis, duplicate_rows
from tersa.operators.catalog import apply_operation
from tersa.operators.compare import compare_tables
from tersa.operators.privacy import mask_by_hint, mask_embedded, masked_sample
from tersa.operators.profile import profile, profile_report
from tersa.operators.quality import (
    before_after, quality_issues, quality_overall, quality_scores, score_band,
)
from tersa.operators.selection import frequent_values
from tersa.operators.state import ProfileStore
from tersa.plans.execute import execute_plan, fit_plan, replay_plan, run_plan
from tersa.plans.propose import findings, guardrail, plan_from_findings, propose_plan
from tersa.plans.steps import Step, collect_steps, plan_to_json
from tersa.sources.files import scan_csv, scan_parquet, write_clean
from tersa.sources.hygiene import (
    count_empty_rows, dataset_metadata, drop_empty_rows, fingerprint, validate_ingest,
)
from tersa.streaming.replay import replay_stream
from tersa.workload import oracle as O
from tersa.workload.views import cte, shared_folder, table, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def _with(view_name: str, body: str) -> str:
    return f"WITH {cte(view_name)} {body}"


# --- flagship --------------------------------------------------------------------------------------

_CLAMPED = f"CASE WHEN n < 0 THEN 0.0 ELSE n END"
_FLAGSHIP_SQL = _with("clientes", f"""
, parsed AS (SELECT lower(trim(segmento)) AS segmento, {O.number('importe')} AS n FROM clientes)
SELECT segmento, count(*) AS clientes, round_even(avg({_CLAMPED}), 4) AS importe_medio
FROM parsed GROUP BY segmento""")


@register("flagship_clean_and_aggregate", _FLAGSHIP_SQL)
def flagship(spark, sf_dir):
    """Mixed number text -> numbers >= 0 -> mean per segment."""
    df = view(spark, sf_dir, "clientes").select("segmento", "importe")
    steps = [
        Step("trim_text", "segmento"), Step("normalize_case", "segmento", {"mode": "lower"}),
        Step("convert_numeric", "importe"), Step("clamp_range", "importe", {"min_value": 0}),
    ]
    clean = execute_plan(df, steps).frame
    return clean.groupBy("segmento").agg(
        F.count(F.lit(1)).alias("clientes"),
        numbers.round_even(F.avg("importe"), 4).alias("importe_medio"),
    )


# --- S: sources, hygiene, sinks ----------------------------------------------------------------------


def _dirty_csv(spark, sf_dir) -> str:
    """Orders as ';'-separated text without quoting: one record in fifty has a field too many."""
    path = shared_folder(spark, "csv")
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(
        key.alias("clave"),
        F.when(key % 5 == 0, "N/A").when(key % 5 == 1, "N/D").otherwise(F.col("o_orderstatus")).alias("estado"),
        F.when(key % 50 == 7, F.concat("o_orderpriority", F.lit(";x"))).otherwise(F.col("o_orderpriority"))
        .alias("prioridad"),
    )
    orders.write.option("header", True).option("sep", ";").option("quote", "\u0000").csv(path)
    return path


@register("s1_scan_csv", """
SELECT o_orderkey AS clave, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'N/D' ELSE o_orderstatus END AS estado,
  o_orderpriority AS prioridad FROM orders WHERE o_orderkey % 50 <> 7""")
def s1(spark, sf_dir):
    return scan_csv(spark, _dirty_csv(spark, sf_dir))


def _raw_csv(spark, sf_dir, name: str, header: str, line) -> str:
    """Orders as lines that are written as they are, each file with the header."""
    path = shared_folder(spark, name)
    lines = table(spark, sf_dir, "orders").select(line.alias(header))
    lines.write.option("header", True).option("sep", "\u0001").option("quote", "\u0000").csv(path)
    return path


@register("s2_malformed_rows", """
SELECT o_orderkey AS clave, o_orderstatus AS estado, CASE o_orderkey % 50 WHEN 8 THEN NULL WHEN 9 THEN 'a;b'
  WHEN 11 THEN 'dice "si"; no' ELSE o_orderpriority END AS prioridad
FROM orders WHERE o_orderkey % 50 NOT IN (7, 10)""")
def s2(spark, sf_dir):
    """Overlong and short records, separators and quotes inside quotes, and an overlong quoted record."""
    kind = F.col("o_orderkey") % 50
    start = F.concat_ws(";", F.col("o_orderkey"), "o_orderstatus")
    line = (
        F.when(kind == 7, F.concat_ws(";", start, "o_orderpriority", F.lit("x")))
        .when(kind == 8, start)
        .when(kind == 9, F.concat(start, F.lit(';"a;b"')))
        .when(kind == 10, F.concat(start, F.lit(';"a;b";x')))
        .when(kind == 11, F.concat(start, F.lit(';"dice ""si""; no"')))
        .otherwise(F.concat_ws(";", start, "o_orderpriority"))
    )
    path = _raw_csv(spark, sf_dir, "malformed", "clave;estado;prioridad", line)
    return scan_csv(spark, path, sep=";", columns=["clave", "estado", "prioridad"])


@register("s1_scan_csv_long_ids", """
SELECT 1234567890123000000 + o_orderkey AS clave, '99' || lpad(CAST(o_orderkey AS VARCHAR), 20, '0') AS codigo,
  o_orderkey / 2 AS mitad FROM orders""")
def s1_long_ids(spark, sf_dir):
    """Whole numbers of 19 digits stay whole; longer codes stay text."""
    key = F.col("o_orderkey")
    code = F.concat(F.lit("99"), F.lpad(key.cast("string"), 20, "0"))
    half = F.format_string("%.1f", key / 2)
    line = F.concat_ws(",", (F.lit(1234567890123000000) + key).cast("string"), code, half)
    return scan_csv(spark, _raw_csv(spark, sf_dir, "ids", "clave,codigo,mitad", line), sep=",")


@register("s3_reader_na_tokens", """
SELECT CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'N/D' ELSE o_orderstatus END AS estado,
  count(*) AS n FROM orders WHERE o_orderkey % 50 <> 7 GROUP BY 1""")
def s3(spark, sf_dir):
    return s1(spark, sf_dir).groupBy("estado").agg(F.count(F.lit(1)).alias("n"))


@register("s4_scan_parquet", """
SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1""")
def s4(spark, sf_dir):
    df = scan_parquet(spark, f"{sf_dir}/orders.parquet").where("o_totalprice > 100000")
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


_EMPTY = " AND ".join(
    f"({c} IS NULL OR trim({c}) IN ({O.quoted(V.EMPTY_ROW_TOKENS)}))" for c in ("clave", "estado", "prioridad")
)


@register("s5_drop_empty_rows", _with("vacias", f"SELECT * FROM vacias WHERE NOT ({_EMPTY})"))
def s5(spark, sf_dir):
    return drop_empty_rows(view(spark, sf_dir, "vacias"))


@register("e8_audit_empty_rows", _with("vacias", f"""SELECT count(*) AS rows_read,
  count(*) FILTER (WHERE {_EMPTY}) AS rows_purged, count(*) FILTER (WHERE NOT ({_EMPTY})) AS rows_kept FROM vacias"""))
def e8(spark, sf_dir):
    return count_empty_rows(view(spark, sf_dir, "vacias"))


@register("s6_validate_ingest", """
SELECT 'warning' AS level, 'MANY_ROWS' AS code, count(*) AS value, CAST(1000 AS BIGINT) AS "limit"
FROM orders HAVING count(*) > 1000
UNION ALL SELECT 'warning', 'MANY_COLUMNS', CAST(6 AS BIGINT), CAST(5 AS BIGINT)""")
def s6(spark, sf_dir):
    return validate_ingest(table(spark, sf_dir, "orders"), max_rows=1000, max_columns=5)


@register("s7_dataset_metadata", """
SELECT 'customer' AS dataset, count(*) AS row_count, CAST(5 AS BIGINT) AS column_count,
  'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS columns,
  CASE WHEN count(*) > 100000 THEN 'MANY_ROWS' ELSE '' END AS warnings FROM customer""")
def s7(spark, sf_dir):
    meta = dataset_metadata(table(spark, sf_dir, "customer"), "customer")
    return meta.withColumns({"columns": F.array_join("columns", ","), "warnings": F.array_join("warnings", ",")})


@register("s8_write_clean", _with("clientes", f"""
SELECT id_cliente, {O.number('importe')} AS importe FROM clientes"""))
def s8(spark, sf_dir):
    df = view(spark, sf_dir, "clientes").select("id_cliente", "importe")
    path = shared_folder(spark, "clean")
    write_clean(apply_operation(df, "convert_numeric", "importe"), path)
    return scan_parquet(spark, path)


@register("s9_fingerprint", "SELECT count(*) AS row_count, true AS order_insensitive, true AS sees_changes FROM orders")
def s9(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    moved = df.repartition(5, "o_custkey")
    changed = df.withColumn("o_totalprice", F.col("o_totalprice") + 1)
    one = fingerprint(df).select("row_count", F.struct("hash_xor", "hash_sum").alias("h"))
    return one.select(
        "row_count",
        (F.col("h") == fingerprint(moved).select(F.struct("hash_xor", "hash_sum")).scalar()).alias("order_insensitive"),
        (F.col("h") != fingerprint(changed).select(F.struct("hash_xor", "hash_sum")).scalar()).alias("sees_changes"),
    )


# --- T: catalog operations ---------------------------------------------------------------------------


def _operation(name: str, view_name: str, key: str, column: str, sql: str, operation: str, **params) -> None:
    """Register one row operation over a whole view: key and cleaned column."""
    body = f"SELECT {key}, {sql} AS {column} FROM {view_name}"

    @register(name, _with(view_name, body))
    def run(spark, sf_dir):
        df = view(spark, sf_dir, view_name).select(key, column)
        return apply_operation(df, operation, column, **params)


_operation("t1_trim_text", "clientes", "id_cliente", "nombre_cliente",
           r"trim(regexp_replace(nombre_cliente, '\s+', ' ', 'g'))", "trim_text")
_operation("t2a_title_case", "piezas", "id_pieza", "nombre", O.smart_title("nombre"), "normalize_case")
_operation("t2b_lower_case", "piezas", "id_pieza", "nombre", "lower(nombre)", "normalize_case", mode="lower")
_operation("t2c_upper_case", "piezas", "id_pieza", "nombre", "upper(nombre)", "normalize_case", mode="upper")
_operation("t3_normalize_category", "pedidos", "id_pedido", "estado",
           "CASE estado WHEN 'O' THEN 'Abierto' WHEN 'F' THEN 'Cerrado' ELSE estado END",
           "normalize_category", mappings={"O": "Abierto", "F": "Cerrado"})
_operation("t4_convert_datetime", "pedidos", "id_pedido", "fecha_pedido",
           f"strftime({O.date('fecha_pedido')}, '%Y-%m-%d')", "convert_datetime")
_operation("t4_convert_datetime_format", "pedidos", "id_pedido", "fecha_pedido",
           f"strftime({O.date('fecha_pedido')}, '%d.%m.%y')", "convert_datetime", target_format="%d.%m.%y")
_operation("t5_convert_numeric", "clientes", "id_cliente", "importe", O.number("importe"), "convert_numeric")
_operation("t7_clamp_floor", "clientes", "id_cliente", "saldo",
           "CASE WHEN saldo < 0 THEN 0.0 ELSE saldo END", "clamp_range", min_value=0)
_operation("t7_clamp_range", "clientes", "id_cliente", "saldo",
           "CASE WHEN saldo < 0 THEN 0.0 WHEN saldo > 5000 THEN 5000.0 ELSE saldo END",
           "clamp_range", min_value=0, max_value=5000)
_operation("t8a_fill_constant", "pedidos", "id_pedido", "prioridad",
           "CASE WHEN trim(prioridad) <> '' THEN prioridad ELSE 'Desconocido' END", "fill_missing")
_operation("t8c_fill_median", "pedidos", "id_pedido", "total",
           "coalesce(total, (SELECT median(total) FROM pedidos))", "fill_missing", strategy="median")
_operation("t8d_fill_mode", "pedidos", "id_pedido", "prioridad", """CASE WHEN trim(prioridad) <> '' THEN prioridad
  ELSE (SELECT prioridad FROM pedidos WHERE trim(prioridad) <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) END""",
           "fill_missing", strategy="mode")


@register("t3_normalize_category_large", """
SELECT p_partkey, CASE WHEN regexp_full_match(p_brand, 'Brand#\\d+') THEN 'Marca ' || substr(p_brand, 7)
  ELSE p_brand END AS p_brand FROM part""")
def t3_large(spark, sf_dir):
    """A dictionary too long for an expression becomes a join."""
    mappings = {f"Brand#{i}": f"Marca {i}" for i in range(100)}
    df = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return apply_operation(df, "normalize_category", "p_brand", mappings=mappings)


@register("t6_round_numeric", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round_even(l_extendedprice * (1 - l_discount), 2) AS importe FROM lineitem""")
def t6(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice * (1 - l_discount) AS importe"
    )
    return apply_operation(df, "round_numeric", "importe")


@register("t8b_fill_mean", _with("pedidos", """
SELECT id_pedido, round_even(coalesce(total, (SELECT avg(total) FROM pedidos)), 4) AS total FROM pedidos"""))
def t8b(spark, sf_dir):
    df = view(spark, sf_dir, "pedidos").select("id_pedido", "total")
    filled = apply_operation(df, "fill_missing", "total", strategy="mean")
    return filled.withColumn("total", numbers.round_even(F.col("total"), 4))


@register("t9a_remove_duplicates", _with("actividad", "SELECT DISTINCT usuario, tipo FROM actividad"))
def t9a(spark, sf_dir):
    return apply_operation(view(spark, sf_dir, "actividad"), "remove_duplicates")


@register("t9b_remove_duplicates_by_key", """
SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1""")
def t9b(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return apply_operation(df, "remove_duplicates", order_by="event_id", subset_columns=["user_id", "event_type"])


@register("t9b_keep_first_in_file", """
SELECT l_orderkey, l_suppkey, l_returnflag, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY i) AS r
  FROM (SELECT *, row_number() OVER () AS i FROM lineitem)) WHERE r = 1""")
def t9b_file(spark, sf_dir):
    """Without a column of order, the first row is the one that comes first in the file, however it is split."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_extendedprice")
    return apply_operation(df, "remove_duplicates", subset_columns=["l_suppkey", "l_returnflag"])


@register("t10_rename_column", "SELECT s_suppkey, s_name AS proveedor, s_acctbal FROM supplier")
def t10(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return apply_operation(df, "rename_column", "s_name", new_name="proveedor")


@register("t11_drop_column", "SELECT s_suppkey, s_name FROM supplier")
def t11(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return apply_operation(df, "drop_column", "s_acctbal")


# --- N: scalar functions -----------------------------------------------------------------------------


def _scalar(name: str, view_name: str, key: str, sql: str, make) -> None:
    @register(name, _with(view_name, f"SELECT {key}, {sql} AS result FROM {view_name}"))
    def run(spark, sf_dir):
        return view(spark, sf_dir, view_name).select(key, make().alias("result"))


_scalar("n1_parse_number", "clientes", "id_cliente", O.number("importe"), lambda: numbers.parse_number(F.col("importe")))
_scalar("n2_is_missing_marker", "clientes", "id_cliente", O.marker("importe"),
        lambda: numbers.is_missing_marker(F.col("importe")))
_scalar("n3_coerce_number", "clientes", "id_cliente",
        r"CASE WHEN regexp_full_match(importe, '[+-]?\d+(\.\d+)?') THEN try_cast(importe AS DOUBLE) END",
        lambda: numbers.coerce_number(F.col("importe")))
_scalar("n4_blank_to_null", "pedidos", "id_pedido", "CASE WHEN trim(prioridad) <> '' THEN prioridad END",
        lambda: text.blank_to_null(F.col("prioridad")))
_scalar("n5_has_excess_whitespace", "clientes", "id_cliente", O.excess("nombre_cliente"),
        lambda: text.has_excess_whitespace(F.col("nombre_cliente")))
_scalar("n6_is_all_caps", "clientes", "id_cliente", O.caps("nombre_cliente"),
        lambda: text.is_all_caps(F.col("nombre_cliente")))
_scalar("n7_has_symbol", "clientes", "id_cliente", O.symbol("importe"), lambda: numbers.has_symbol(F.col("importe")))
_scalar("n8_is_code_token", "piezas", "id_pieza", f"regexp_full_match(split_part(nombre, ' ', 3), '{V.CODE_TOKEN}')",
        lambda: text.is_code_token(F.split_part(F.col("nombre"), F.lit(" "), F.lit(3))))
_scalar("n9_parse_date", "pedidos", "id_pedido", f"CAST({O.date('fecha_pedido')} AS DATE)",
        lambda: dates.parse_date(F.col("fecha_pedido")))
_scalar("n9_is_invalid_date", "pedidos", "id_pedido", f"({O.date('fecha_pedido')}) IS NULL",
        lambda: dates.is_invalid_date(F.col("fecha_pedido"), dates.parse_date(F.col("fecha_pedido"))))
_DATE_TEXTS = {
    # kind: Spark expression over events, the date that it says (DuckDB)
    0: ("date_format(ts, 'yyyy')", "CAST(date_trunc('year', ts) AS DATE)"),
    1: ("date_format(ts, 'MMM yyyy')", "CAST(date_trunc('month', ts) AS DATE)"),
    2: ("date_format(ts, 'MMMM yyyy')", "CAST(date_trunc('month', ts) AS DATE)"),
    3: ("date_format(ts, 'yyyyMMdd HH:mm')", "CAST(ts AS DATE)"),
    4: ("concat(date_format(ts, 'yyyy-MM-dd'), 'T', date_format(ts, 'HH'))", "CAST(ts AS DATE)"),
    5: ("concat(day(ts), ' Decorations ', year(ts))", "NULL"),
    6: ("concat('Marbles ', day(ts), ', ', year(ts))", "NULL"),
    7: ("date_format(ts, 'd MMM yyyy')", "CAST(ts AS DATE)"),
    8: ("upper(date_format(ts, 'MMMM d, yyyy'))", "CAST(ts AS DATE)"),
    9: ("'9999-12-31'", "NULL"),
}


def _date_texts(spark, sf_dir) -> DataFrame:
    cases = " ".join(f"WHEN {k} THEN {text}" for k, (text, _) in _DATE_TEXTS.items())
    return table(spark, sf_dir, "events").selectExpr("event_id", f"CASE event_id % 10 {cases} END AS fecha")


_SAID = "CASE event_id % 10 " + " ".join(f"WHEN {k} THEN {said}" for k, (_, said) in _DATE_TEXTS.items()) + " END"


@register("n9_parse_date_texts", f"SELECT event_id, {_SAID} AS fecha FROM events")
def n9_texts(spark, sf_dir):
    """Years, months with names, compact dates with a time, hours alone; prose with a day and a year is no date."""
    return _date_texts(spark, sf_dir).withColumn("fecha", dates.parse_date(F.col("fecha")))


@register("t4_convert_datetime_any_year", f"""
SELECT event_id, strftime(CASE WHEN event_id % 10 = 9 THEN DATE '9999-12-31' ELSE {_SAID} END, '%Y-%m-%d') AS fecha FROM events""")
def t4_any_year(spark, sf_dir):
    return apply_operation(_date_texts(spark, sf_dir), "convert_datetime", "fecha", any_year=True)


_scalar("n10_date_format_class", "pedidos", "id_pedido", O.date_class("fecha_pedido"),
        lambda: dates.format_class(F.col("fecha_pedido"), dates.parse_date(F.col("fecha_pedido"))))
_scalar("n11_is_yes", "pedidos", "id_pedido", "lower(urgente) IN ('si', 'yes', 'true', '1')",
        lambda: text.is_yes(F.col("urgente")))
_scalar("n12_is_boolean_token", "pedidos", "id_pedido", f"lower(urgente) IN ({O.quoted(V.BOOLEAN_TOKENS)})",
        lambda: text.is_boolean_token(F.col("urgente")))
_scalar("n13_json_safe", "pedidos", "id_pedido", "CASE WHEN isfinite(total * 1e305) THEN total * 1e305 END",
        lambda: numbers.finite(F.col("total") * F.lit(1e305)))
_scalar("n14_format_eur", "clientes", "id_cliente",
        "translate(format('{:,.2f}', saldo), ',.', '.,') || ' €'", lambda: numbers.format_eur(F.col("saldo")))

_TRIMMED = f"trim(text, '{text.SPACE_CHARS}')"
_MASKED = f"""CASE WHEN text IS NULL OR {_TRIMMED} = '' THEN text
  WHEN regexp_full_match({_TRIMMED}, '{V.EMAIL}') THEN '[EMAIL]'
  WHEN regexp_full_match({_TRIMMED}, '{V.PHONE}') THEN '[TELÉFONO]'
  WHEN regexp_matches({_TRIMMED}, '{V.EMAIL}') THEN regexp_replace({_TRIMMED}, '{V.EMAIL}', '[EMAIL]', 'g')
  ELSE text END"""


@register("n15_mask_value", f"SELECT conv_id, turn, {_MASKED} AS result FROM conversations")
def n15(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", masks.mask_value(F.col("text")).alias("result")
    )


@register("n16_id_columns", O.analysed("clientes") + f"""
SELECT column_name, {O.name_like(V.ID_WORDS_QUALITY, V.ID_PREFIXES, V.ID_SUFFIXES)} AS is_id, unique_count FROM facts""")
def n16(spark, sf_dir):
    """Which columns are named like ids, next to how many values they have."""
    found = profile(view(spark, sf_dir, "clientes"), order_by="id_cliente")
    is_id = names.is_id_name(F.col("column_name"), V.ID_WORDS_QUALITY)
    return found.select("column_name", is_id.alias("is_id"), "unique_count")


@register("n17_percent_columns", O.analysed("clientes") + f"""
SELECT column_name, (has_percent OR {O.PERCENT_NAME}) AS is_percent FROM facts""")
def n17(spark, sf_dir):
    facts = Analysis(view(spark, sf_dir, "clientes")).facts
    is_percent = F.col("has_percent") | names.is_percent_name(F.col("column_name"))
    return facts.select("column_name", is_percent.alias("is_percent"))


# --- P: profiling ------------------------------------------------------------------------------------


@register("p1_row_and_column_count", "SELECT count(*) AS row_count, CAST(11 AS BIGINT) AS column_count FROM lineitem")
def p1(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "column_count", F.lit(len(df.columns)).cast("bigint")
    )


@register("p2_duplicate_rows", _with("actividad", """
SELECT count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM actividad)) AS duplicates_count,
  round_even((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM actividad))) / count(*) * 100, 2)
  AS duplicates_percentage FROM actividad"""))
def p2(spark, sf_dir):
    return duplicate_rows(view(spark, sf_dir, "actividad"))


def _profile(name: str, view_name: str, sql: str, pick) -> None:
    @register(name, O.analysed(view_name) + f" SELECT column_name, {sql} FROM facts")
    def run(spark, sf_dir):
        key = O.PROFILED[view_name][0][0]
        return pick(profile(view(spark, sf_dir, view_name), order_by=key))


_PCT = "round_even(nulls / row_count * 100, 2)"
_profile("p4_null_counts", "pedidos", f"nulls AS null_count, {_PCT} AS null_percentage",
         lambda p: p.select("column_name", "null_count", "null_percentage"))
_profile("p5_unique_count", "clientes", "unique_count", lambda p: p.select("column_name", "unique_count"))
_profile("p7_infer_type", "pedidos", "inferred_type", lambda p: p.select("column_name", "inferred_type"))
_profile("p7_infer_type_clientes", "clientes", "inferred_type", lambda p: p.select("column_name", "inferred_type"))
_profile("p8_semantic_hint", "clientes", "semantic_hint", lambda p: p.select("column_name", "semantic_hint"))
_profile("p8_semantic_hint_pedidos", "pedidos", "semantic_hint", lambda p: p.select("column_name", "semantic_hint"))

_NUMERIC = "CASE WHEN inferred_type = 'numeric' THEN {} END"
_STATS = ", ".join(
    f"{_NUMERIC.format(x)} AS {n}" for x, n in [
        ("lo", "min_value"), ("hi", "max_value"), ("round_even(mean, 2)", "mean"),
        ("round_even(med, 2)", "median"), ("round_even(sd, 2)", "std"),
    ]
)
_profile("p9_numeric_stats", "clientes", _STATS,
         lambda p: p.select("column_name", "min_value", "max_value", "mean", "median", "std"))
_WARN = f"""concat_ws('|', CASE WHEN {_PCT} > 20 THEN 'Muchos nulos: ' || CAST({_PCT} AS VARCHAR) || '%' END,
  CASE WHEN unique_count = 1 AND row_count > 1 THEN 'Columna constante' END,
  CASE WHEN inferred_type = 'text' AND unique_count = row_count AND row_count > 1
    THEN 'Cardinalidad máxima: ningún texto se repite' END) AS warnings"""
_profile("p10_column_warnings", "pedidos", _WARN,
         lambda p: p.select("column_name", F.array_join("warnings", "|").alias("warnings")))
_profile("p12_profile", "pedidos", f"""false AS estimated, position, inferred_type, semantic_hint, nulls AS null_count,
  {_PCT} AS null_percentage, unique_count, {_STATS}, {_WARN}""",
         lambda p: p.drop("sample_values").withColumn("warnings", F.array_join("warnings", "|")))

_SAMPLE = """SELECT column_name, string_agg(txt, '|' ORDER BY r) AS sample_values FROM (
  SELECT column_name, txt, row_number() OVER (PARTITION BY position ORDER BY first) AS r FROM (
    SELECT position, column_name, txt, min(row_id) AS first FROM cells WHERE trim(txt) <> '' GROUP BY ALL))
WHERE r <= 5 GROUP BY column_name"""


@register("p6_sample_values", O.analysed("clientes") + _SAMPLE)
def p6(spark, sf_dir):
    p = profile(view(spark, sf_dir, "clientes"), order_by="id_cliente")
    return p.select("column_name", F.array_join("sample_values", "|").alias("sample_values"))


@register("p6_sample_values_approx", O.analysed("pedidos") + _SAMPLE)
def p6_approx(spark, sf_dir):
    """The approximate mode finds the same first values, in all rows."""
    p = profile(view(spark, sf_dir, "pedidos"), order_by="id_pedido", approx=True)
    return p.select("column_name", F.array_join("sample_values", "|").alias("sample_values"))


@register("p6_sample_values_in_file", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, string_agg(v, '|' ORDER BY i) AS sample_values FROM (SELECT {c} AS v, min(i) AS i FROM
  (SELECT *, row_number() OVER () AS i FROM {t}) GROUP BY 1 ORDER BY 2 LIMIT 5)""" for c, t in (
    ("o_orderstatus", "orders"), ("o_orderpriority", "orders"), ("event_type", "events"), ("p_name", "part"), ("p_type", "part"))))
def p6_file(spark, sf_dir):
    """The first values in the order of the file's rows, in both modes."""
    found = []
    for name, columns, approx in (("orders", ["o_orderstatus", "o_orderpriority"], False), ("events", ["event_type"], True),
                                  ("part", ["p_name", "p_type"], False)):
        found.append(profile(table(spark, sf_dir, name).select(*columns), approx=approx))
    samples = found[0].unionByName(found[1]).unionByName(found[2])
    return samples.select("column_name", F.array_join("sample_values", "|").alias("sample_values"))


@register("p5_unique_decimals", """
SELECT 'importe' AS column_name, count(DISTINCT o_custkey) AS unique_count FROM orders""")
def p5_decimals(spark, sf_dir):
    """Twenty-digit decimals that a double would not tell apart."""
    df = table(spark, sf_dir, "orders").selectExpr("CAST(12345678901234000000 + o_custkey AS DECIMAL(20,0)) AS importe")
    return profile(df).select("column_name", "unique_count")


@register("p2_duplicate_rows_wide", """
SELECT count(*) AS row_count, count(*) - count(DISTINCT l_returnflag || l_linestatus) AS duplicates_count FROM lineitem""")
def p2_wide(spark, sf_dir):
    """0.0 and -0.0 are one value next to long texts too, as they are for the dedup step."""
    df = table(spark, sf_dir, "lineitem").selectExpr(
        "IF(l_linenumber % 2 = 0, -0.0D, 0.0D) AS cero", "concat(l_returnflag, l_linestatus, repeat('x', 60)) AS nota"
    )
    return duplicate_rows(df).select("row_count", "duplicates_count")


@register("p3_memory_estimate", O.analysed("clientes") + """
SELECT CAST(sum(text_bytes) AS BIGINT) AS memory_estimate_bytes FROM facts""")
def p3(spark, sf_dir):
    return profile_report(view(spark, sf_dir, "clientes")).select("memory_estimate_bytes")


@register("p11_global_warnings", _with("actividad", """, s AS (SELECT count(*) AS n,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM actividad)) AS d FROM actividad)
SELECT n AS row_count, CAST(2 AS BIGINT) AS column_count, d AS duplicates_count,
  d || ' fila(s) repetidas (' || CAST(round_even(d / n * 100, 2) AS VARCHAR) || '%)' AS global_warnings FROM s"""))
def p11(spark, sf_dir):
    report = profile_report(view(spark, sf_dir, "actividad"))
    return report.select("row_count", "column_count", "duplicates_count",
                         F.array_join("global_warnings", "|").alias("global_warnings"))


@register("p12_profile_approx", O.analysed("pedidos") + f"""
SELECT column_name, inferred_type, semantic_hint, nulls AS null_count, {_NUMERIC.format('lo')} AS min_value,
  {_NUMERIC.format('hi')} AS max_value, {_NUMERIC.format('round_even(mean, 2)')} AS mean, true AS estimated FROM facts""")
def p12_approx(spark, sf_dir):
    """The approximate mode over the whole table; the columns of it that are exact."""
    p = profile(view(spark, sf_dir, "pedidos"), order_by="id_pedido", approx=True)
    return p.select("column_name", "inferred_type", "semantic_hint", "null_count", "min_value", "max_value", "mean", "estimated")


def _stored_profile(spark, sf_dir, name: str, key: str, parts: int):
    """A view that comes in parts, each profiled alone; the first one is profiled again and replaces itself."""
    df, store = view(spark, sf_dir, name), ProfileStore(spark, shared_folder(spark, "profile"))
    for i in [*range(parts), 0]:
        store.add(df.where(F.col(key) % parts == i), f"part {i}", order_by=key)
    return store


@register("p12_profile_of_parts", O.analysed("pedidos") + f"""
SELECT column_name, inferred_type, semantic_hint, nulls AS null_count, {_PCT} AS null_percentage, {_NUMERIC.format('lo')} AS min_value,
  {_NUMERIC.format('hi')} AS max_value, {_NUMERIC.format('round_even(mean, 2)')} AS mean, {_NUMERIC.format('round_even(sd, 2)')} AS std,
  true AS estimated, true AS unique_close, true AS median_close, true AS sampled FROM facts""")
def p12_parts(spark, sf_dir):
    """Three parts, profiled one by one and merged; sketches are held against the exact profile of the whole table."""
    merged = _stored_profile(spark, sf_dir, "pedidos", "id_pedido", 3).profile()
    exact = profile(view(spark, sf_dir, "pedidos"), order_by="id_pedido").select(
        "column_name", F.col("unique_count").alias("unique"), F.col("median").alias("middle"),
        (F.col("max_value") - F.col("min_value")).alias("width"),
    )
    near = F.abs(F.col("unique_count") - F.col("unique")) <= F.col("unique") * 0.03
    middle = F.coalesce(F.abs(F.col("median") - F.col("middle")) <= F.col("width") * 0.03, F.col("median").isNull() & F.col("middle").isNull())
    return merged.join(exact, "column_name").select(
        "column_name", "inferred_type", "semantic_hint", "null_count", "null_percentage", "min_value", "max_value", "mean", "std",
        "estimated", near.alias("unique_close"), middle.alias("median_close"), (F.size("sample_values") > 0).alias("sampled"),
    )


@register("p1_rows_of_parts", _with("clientes", """
SELECT 'part ' || CAST(id_cliente % 4 AS INTEGER) AS part, count(*) AS rows FROM clientes GROUP BY 1"""))
def p1_parts(spark, sf_dir):
    return _stored_profile(spark, sf_dir, "clientes", "id_cliente", 4).parts()


_FREQUENT = {
    "lineitem": ["l_returnflag", "l_partkey", "l_shipdate", "l_quantity", "l_orderkey"], "events": ["user_id", "event_type"],
}


@register("t8d_frequent_values", "SELECT column_name, value, n, rank FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n,
  row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS rank FROM {t} WHERE {c} IS NOT NULL GROUP BY 1, 2"""
    for t, columns in _FREQUENT.items() for c in columns) + ") WHERE rank <= 5")
def t8d_frequent(spark, sf_dir):
    """The five most frequent values of columns with few, many and nearly equal counts, in one plan a table."""
    def top(name, columns):
        def text(c):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss") if c == "l_shipdate" else F.col(c).cast("string")

        cells = [x for c in columns for x in (F.lit(c), text(c))]
        df = table(spark, sf_dir, name).select(F.stack(F.lit(len(columns)), *cells).alias("column_name", "v"))
        return frequent_values(df, 5, "column_name", group_bytes=0)  # by buckets, however small the table is

    found = [top(name, columns) for name, columns in _FREQUENT.items()]
    return found[0].unionByName(found[1]).select("column_name", F.col("v").alias("value"), "n", F.col("rank").cast("bigint").alias("rank"))


# --- T3: proposed spellings ----------------------------------------------------------------------------

_CLUSTERS = f"""
, cells AS (SELECT 'nombre' AS column_name, nombre AS value FROM productos UNION ALL SELECT 'marca', marca FROM productos),
vals AS (SELECT column_name, value, trim(value) AS label, array_to_string(list_sort(list_distinct(string_split(trim(regexp_replace(
    translate(lower(value), '{spelling.ACCENTED}', '{spelling.PLAIN}'), '[\\p{{Z}}\\p{{P}}\\p{{S}}\\p{{C}}]+', ' ', 'g')), ' '))), ' ') AS key,
    count(*) AS n FROM cells WHERE value IS NOT NULL GROUP BY ALL),
labels AS (SELECT column_name, key, label, sum(n) AS n FROM vals WHERE key <> '' GROUP BY ALL),
nodes AS (SELECT column_name, key, sum(n) AS n, first(label ORDER BY n DESC, label) AS canonical,
    regexp_replace(key, '[^0-9]+', ' ', 'g') AS digits FROM labels GROUP BY ALL),
parents AS (SELECT a.column_name, a.key, arg_max(b.key, (b.n, b.key)) AS parent FROM nodes a JOIN nodes b ON a.column_name = b.column_name
    AND a.digits = b.digits AND length(a.key) BETWEEN 5 AND 64 AND length(b.key) BETWEEN 5 AND 64 AND b.n >= 4 * a.n
    AND damerau_levenshtein(a.key, b.key) = 1 GROUP BY ALL),
paths AS (SELECT column_name, key, key AS root, 0 AS steps FROM nodes UNION ALL
  SELECT w.column_name, w.key, p.parent, w.steps + 1 FROM paths w JOIN parents p ON p.column_name = w.column_name AND p.key = w.root),
roots AS (SELECT column_name, key, arg_max(root, steps) AS root FROM paths GROUP BY ALL),
proposed AS (SELECT v.column_name, v.value, e.canonical, v.n, CAST(e.n AS BIGINT) AS canonical_n,
    CASE WHEN v.key = r.root THEN 'spelling' ELSE 'typo' END AS kind
  FROM vals v JOIN roots r USING (column_name, key) JOIN nodes e ON e.column_name = r.column_name AND e.key = r.root WHERE v.value <> e.canonical)"""


@register("t3_propose_mappings", _with("productos", _CLUSTERS + " SELECT * FROM proposed").replace("WITH ", "WITH RECURSIVE ", 1))
def t3_propose(spark, sf_dir):
    """Spellings and typos of both columns; brands that differ in a digit stay apart."""
    return spelling.propose_mappings(view(spark, sf_dir, "productos"), ["nombre", "marca"])


@register("t3_apply_proposals", _with("productos", _CLUSTERS + """
SELECT id_producto, coalesce(a.canonical, nombre) AS nombre, coalesce(b.canonical, marca) AS marca FROM productos
  LEFT JOIN proposed a ON a.column_name = 'nombre' AND a.value = nombre LEFT JOIN proposed b ON b.column_name = 'marca' AND b.value = marca
""").replace("WITH ", "WITH RECURSIVE ", 1))
def t3_apply(spark, sf_dir):
    """Proposed, taken over into a plan and executed."""
    df = view(spark, sf_dir, "productos")
    return execute_plan(df, spelling.mapping_steps(spelling.propose_mappings(df))).frame


# --- S9, Q10: two versions of a table ------------------------------------------------------------------

_VERSIONS = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 97 <> 3"""
_CHANGED = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 89 = 5 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 83 = 7 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 101 <> 4"""


@register("s9_compare_tables", f"""
WITH a AS ({_VERSIONS}), b AS ({_CHANGED}), j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
  CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS status,
  CASE WHEN a.o_orderkey IS NULL OR b.o_orderkey IS NULL THEN '' ELSE concat_ws('|',
    CASE WHEN a.o_orderstatus <> b.o_orderstatus THEN 'o_orderstatus' END,
    CASE WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'o_totalprice' END) END AS changed_columns,
  a IS DISTINCT FROM b AS differs FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT o_orderkey, status, changed_columns FROM j WHERE differs""")
def s9_compare(spark, sf_dir):
    """Keys added, removed and changed between two versions of the orders, with the columns that changed."""
    orders = table(spark, sf_dir, "orders")
    before, after = (spark.sql(text.replace("FROM orders", "FROM {orders}"), orders=orders) for text in (_VERSIONS, _CHANGED))
    found = compare_tables(before, after, ["o_orderkey"])
    return found.select("o_orderkey", "status", F.array_join("changed_columns", "|").alias("changed_columns"))


@register("q10_what_a_plan_changed", _with("clientes", f"""
, p AS (SELECT id_cliente, nombre_cliente, {O.smart_title('nombre_cliente')} AS titulo, unidades, coalesce(unidades, 0) AS lleno FROM clientes)
SELECT id_cliente, concat_ws('|', CASE WHEN nombre_cliente <> titulo THEN 'nombre_cliente' END, CASE WHEN unidades IS NULL THEN 'unidades' END)
  AS changed_columns FROM p WHERE nombre_cliente <> titulo OR unidades IS NULL"""))
def q10_changed(spark, sf_dir):
    """The customers that a plan changes, and where."""
    df = view(spark, sf_dir, "clientes")
    done = execute_plan(df, [Step("normalize_case", "nombre_cliente"), Step("fill_missing", "unidades", {"value": 0})])
    clean = done.frame.withColumn("unidades", F.col("unidades").cast(df.schema["unidades"].dataType))
    found = compare_tables(df, clean, ["id_cliente"])
    return found.select("id_cliente", F.array_join("changed_columns", "|").alias("changed_columns"))


# --- Q: quality --------------------------------------------------------------------------------------

_SEVERITY = """CASE kind WHEN 'nulls' THEN CASE WHEN share > 50 THEN 'critical' WHEN share > 20 THEN 'high' ELSE 'medium' END
  WHEN 'duplicates' THEN CASE WHEN share > 5 THEN 'high' ELSE 'medium' END
  WHEN 'whitespace' THEN 'low' WHEN 'case' THEN 'medium' WHEN 'numbers' THEN 'medium' ELSE 'high' END"""


def _issues_sql(view_name: str, where: str = "true") -> str:
    return O.analysed(view_name, "numbered AS (SELECT *, row_number() OVER (ORDER BY d, p, w) AS issue_no, "
                      "round_even(affected_rows / row_total * 100, 2) AS share FROM issues)") + f"""
SELECT issue_no, dimension, {_SEVERITY} AS severity, "column", kind, CAST(affected_rows AS BIGINT) AS affected_rows,
  share AS affected_percentage FROM numbered WHERE {where}"""


def _issues(name: str, view_name: str, dimension: str | None = None) -> None:
    where = f"dimension = '{dimension}'" if dimension else "true"

    @register(name, _issues_sql(view_name, where))
    def run(spark, sf_dir):
        key = O.PROFILED[view_name][0][0]
        found = quality_issues(view(spark, sf_dir, view_name), order_by=key, evidence=False)
        if dimension:
            found = found.where(F.col("dimension") == dimension)
        return found.drop("description", "suggested_action")


_issues("q1_completeness", "pedidos", "completeness")
_issues("q3_consistency", "clientes", "consistency")
_issues("q4_validity_dates", "pedidos", "validity")
_issues("q4_validity_numbers", "clientes", "validity")
_issues("q5_integrity", "clientes", "integrity")
_issues("q9_quality_issues", "clientes")
_issues("q9_quality_issues_pedidos", "pedidos")


@register("q2_uniqueness", _with("actividad", """, s AS (SELECT count(*) AS n,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM actividad)) AS d FROM actividad)
SELECT 'uniqueness' AS dimension, CASE WHEN d / n > 0.05 THEN 'high' ELSE 'medium' END AS severity,
  d AS affected_rows, round_even(d / n * 100, 2) AS affected_percentage FROM s WHERE d > 0"""))
def q2(spark, sf_dir):
    found = quality_issues(view(spark, sf_dir, "actividad"), evidence=False).where("kind = 'duplicates'")
    return found.select("dimension", "severity", "affected_rows", "affected_percentage")


def _scores(name: str, view_name: str) -> None:
    weights = {"completeness": 0.30, "uniqueness": 0.15, "consistency": 0.20, "validity": 0.25, "integrity": 0.10}
    body = " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {d} AS score, CAST({w} AS DOUBLE) AS weight, "
        f"(SELECT count(*) FROM issues WHERE dimension = '{d}') AS issues_count FROM scored"
        for d, w in weights.items()
    )

    @register(name, O.analysed(view_name, O.scores(view_name)) + " " + body)
    def run(spark, sf_dir):
        return quality_scores(view(spark, sf_dir, view_name)).drop("summary")


_scores("q7_dimension_scores", "clientes")
_scores("q7_dimension_scores_pedidos", "pedidos")


@register("q6_overall_score", O.analysed("clientes", O.scores("clientes")) + f"""
SELECT {O.OVERALL} AS overall_score, (SELECT count(*) FROM issues) AS issues_count FROM scored""")
def q6(spark, sf_dir):
    return quality_overall(view(spark, sf_dir, "clientes")).select("overall_score", "issues_count")


@register("q11_score_band", O.analysed("pedidos", O.scores("pedidos")) + f"""
SELECT CASE WHEN {O.OVERALL} >= 85 THEN 'green' WHEN {O.OVERALL} >= 65 THEN 'amber' ELSE 'red' END AS band FROM scored""")
def q11(spark, sf_dir):
    overall = quality_overall(view(spark, sf_dir, "pedidos"))
    return overall.select(score_band(F.col("overall_score")).alias("band"))


_EVIDENCE = f"""offending AS (
  SELECT 'whitespace' AS kind, c.position, row_id, txt AS shown FROM cells c WHERE {O.excess('txt')}
  UNION ALL SELECT 'numbers', c.position, row_id, trim(txt) FROM cells c JOIN checked f USING (position)
    WHERE n_numbers > 0 AND txt IS NOT NULL AND ({O.marker('txt')} OR {O.symbol('txt')} OR num IS NULL)
  UNION ALL SELECT 'case', c.position, row_id, txt FROM cells c JOIN checked f USING (position)
    WHERE n_case > 0 AND all_caps > 0 AND {O.caps('txt')}
  UNION ALL SELECT 'percent_range', c.position, row_id, printf('%.1f', num) FROM cells c JOIN checked f USING (position)
    WHERE n_percent_range > 0 AND (num < 0 OR num > 100)
  UNION ALL SELECT 'negatives', c.position, row_id,
      CASE WHEN num = round(num, 1) THEN printf('%.1f', num) ELSE CAST(num AS VARCHAR) END
    FROM cells c JOIN checked f USING (position) WHERE n_negatives > 0 AND num < 0),
sampled AS (SELECT position, kind, string_agg(shown, '|' ORDER BY row_id) AS evidence FROM (
  SELECT *, row_number() OVER (PARTITION BY position, kind ORDER BY row_id) AS r FROM offending)
  WHERE r <= 3 GROUP BY position, kind)"""


@register("q8_evidence_sample", O.analysed("clientes", _EVIDENCE) + """
SELECT i."column", i.kind, CASE i.kind WHEN 'nulls' THEN '[VALOR VACÍO]' ELSE evidence END AS evidence
FROM issues i LEFT JOIN sampled s ON s.position = i.p AND s.kind = i.kind""")
def q8(spark, sf_dir):
    found = quality_issues(view(spark, sf_dir, "clientes"), order_by="id_cliente")
    return found.select("column", "kind", F.array_join("evidence_sample", "|").alias("evidence"))


_DATE_EVIDENCE = f"""offending AS (
  SELECT c.position, row_id, trim(txt) AS shown FROM cells c JOIN checked f USING (position)
    WHERE n_dates > 0 AND txt IS NOT NULL AND cls IS DISTINCT FROM
      (SELECT cls FROM cells d WHERE d.position = c.position AND cls IS NOT NULL GROUP BY cls ORDER BY count(*) DESC, cls LIMIT 1)),
sampled AS (SELECT position, string_agg(shown, '|' ORDER BY row_id) AS evidence FROM (
  SELECT *, row_number() OVER (PARTITION BY position ORDER BY row_id) AS r FROM offending) WHERE r <= 3 GROUP BY position)"""


@register("q8_evidence_dates", O.analysed("pedidos", _DATE_EVIDENCE) + """
SELECT i."column", evidence FROM issues i JOIN sampled s ON s.position = i.p WHERE i.kind = 'dates'""")
def q8_dates(spark, sf_dir):
    found = quality_issues(view(spark, sf_dir, "pedidos"), order_by="id_pedido").where("kind = 'dates'")
    return found.select("column", F.array_join("evidence_sample", "|").alias("evidence"))


def _clean_pedidos():
    return [
        Step("remove_duplicates"),
        Step("fill_missing", "prioridad", {"strategy": "constant", "value": "Desconocido"}),
        Step("convert_datetime", "fecha_pedido", {"target_format": "%Y-%m-%d"}),
        Step("fill_missing", "total", {"strategy": "median"}),
    ]


_CLEANED = cte("pedidos").replace("pedidos AS (", "sucios AS (", 1) + f""", pedidos AS (
  SELECT id_pedido, strftime({O.date('fecha_pedido')}, '%Y-%m-%d') AS fecha_pedido,
    CASE WHEN trim(prioridad) <> '' THEN prioridad ELSE 'Desconocido' END AS prioridad, estado,
    coalesce(total, (SELECT median(total) FROM sucios)) AS total, urgente FROM sucios)"""
_AFTER_SQL = ("WITH " + ", ".join([_CLEANED, O.cells("pedidos"), O.FACTS, O.dup_cte("pedidos"), O.ISSUES,
              O.scores("pedidos")]) + f" SELECT {O.OVERALL} AS s, (SELECT row_total FROM dup) AS n FROM scored")
_BEFORE_SQL = O.analysed("pedidos", O.scores("pedidos")) + f" SELECT {O.OVERALL} AS s, (SELECT row_total FROM dup) AS n FROM scored"


@register("q10_before_after", f"""
SELECT b.n AS rows_before, a.n AS rows_after, CAST(6 AS BIGINT) AS columns_before, CAST(6 AS BIGINT) AS columns_after,
  b.s AS score_before, a.s AS score_after, CAST(4 AS BIGINT) AS applied_steps, true AS timed FROM ({_BEFORE_SQL}) b, ({_AFTER_SQL}) a""")
def q10(spark, sf_dir):
    df = view(spark, sf_dir, "pedidos")
    path = shared_folder(spark, "clean")
    done, summary = run_plan(df, _clean_pedidos(), path, order_by="id_pedido")
    seconds = summary.select("seconds").first().seconds
    report = before_after(df, scan_parquet(spark, path), len(done.applied), seconds)
    return report.withColumn("timed", F.col("execution_seconds") > 0).drop("execution_seconds")


# --- R: plans ----------------------------------------------------------------------------------------

_TITLE, _ISO = '{"mode": "title"}', '{"target_format": "%Y-%m-%d"}'
_FLOOR, _PCT_RANGE = '{"min_value": 0, "max_value": null}', '{"min_value": 0.0, "max_value": 100.0}'
_CEILING = '{"min_value": null, "max_value": 100.0}'
_CONST, _MEDIAN = '{"strategy": "constant", "value": "Desconocido"}', '{"strategy": "median"}'
_CONST_TEXT = '{"strategy": "constant", "value": "Desconocido", "as_text": true}'
_IS_ID = O.name_like(V.ID_WORDS_PLAN, V.ID_PREFIXES, V.ID_SUFFIXES)
_IS_PCT = f"(has_percent OR {O.PERCENT_NAME})"


def _plan_sql(view_name: str, compat: bool = False) -> str:
    """The rules, said as one SELECT per rule over the checked facts."""
    c = "column_name"
    nulls = (
        [(1, 1, 1, "fill_missing", _CONST_TEXT, "n_nulls", "n_nulls > 0")] if compat else
        [(1, 1, 1, "fill_missing", _CONST, "n_nulls", "n_nulls > 0 AND inferred_type <> 'numeric'"),
         (1, 6, 1, "fill_missing", _MEDIAN, "n_nulls", "n_nulls > 0 AND inferred_type = 'numeric'")]
    )
    readable = "true" if compat else "(inferred_type = 'numeric' OR parsed >= (row_count - nulls) * 0.5)"
    measured = f"(kind = 'number' OR {O.name_like(V.QUANTITY_OR_DATE_WORDS)})"
    rules = nulls + [
        (1, 3, 1, "trim_text", "{}", "n_whitespace", "n_whitespace > 0"),
        (1, 3, 2, "normalize_case", _TITLE, "n_case", "n_case > 0"),
        (1, 4, 1, "convert_datetime", _ISO, "n_dates", "n_dates > 0"),
        (1, 4, 2, "convert_numeric", "{}", "n_numbers", "n_numbers > 0"),
        (1, 5, 1, "clamp_range", _PCT_RANGE, "n_percent_range", "n_percent_range > 0"),
        (1, 5, 2, "clamp_range", _FLOOR, "n_negatives", "n_negatives > 0"),
        (2, 7, 1, "normalize_case", _TITLE, "row_count", f"NOT {_IS_ID} AND NOT {measured} AND all_caps > 0"),
        (2, 7, 2, "trim_text", "{}", "row_count", "excess_space > 0"),
        (2, 7, 3, "convert_numeric", "{}", "row_count", f"NOT {_IS_ID} AND marked AND {readable}"),
        (2, 7, 4, "clamp_range", _FLOOR, "negatives", f"NOT {_IS_ID} AND NOT {_IS_PCT} AND negatives > 0"),
        (2, 7, 5, "clamp_range", _PCT_RANGE, "negatives + over_hundred",
         f"NOT {_IS_ID} AND {_IS_PCT} AND negatives + over_hundred > 0"),
    ]
    return _ranked(view_name, c, rules)


def _sampled_sql(view_name: str) -> str:
    quant = (f"(semantic_hint IN ('currency', 'percentage') OR inferred_type = 'numeric' "
             f"OR {O.name_like(V.SAMPLED_QUANTITY_WORDS)})")
    labelled = f"(semantic_hint IN ('name', 'location') OR {O.name_like(V.SAMPLED_NAME_WORDS)})"
    pct = f"(semantic_hint = 'percentage' OR {O.name_like(V.SAMPLED_PERCENT_WORDS)})"
    rules = [
        (1, 3, 1, "trim_text", "{}", "n_whitespace", "n_whitespace > 0"),
        (1, 3, 2, "normalize_case", _TITLE, "n_case", "n_case > 0"),
        (1, 4, 1, "convert_datetime", _ISO, "n_dates", "n_dates > 0"),
        (1, 4, 2, "convert_numeric", "{}", "n_numbers", "n_numbers > 0"),
        (1, 5, 1, "clamp_range", _CEILING, "n_percent_range", "n_percent_range > 0"),
        (1, 5, 2, "clamp_range", _FLOOR, "n_negatives", "n_negatives > 0"),
        (2, 7, 1, "normalize_case", _TITLE, "all_caps", f"{labelled} AND all_caps > 0"),
        (2, 7, 3, "clamp_range", _FLOOR, "negatives", f"{quant} AND negatives > 0"),
        (2, 7, 4, "clamp_range", _CEILING, "over_hundred", f"{quant} AND {pct} AND over_hundred > 0"),
    ]
    return _ranked(view_name, "column_name", rules)


def _ranked(view_name: str, c: str, rules: list[tuple]) -> str:
    parts = [
        f"SELECT {ph} AS phase, {pl} AS place, position, {rk} AS rk, '{op}' AS operation, {c} AS col, "
        f"'{params}' AS parameters, CAST({estimate} AS BIGINT) AS estimate FROM checked WHERE {where}"
        for ph, pl, rk, op, params, estimate, where in rules
    ]
    parts.append("SELECT 1, 2, -1, 1, 'remove_duplicates', NULL, '{}', CAST(dups AS BIGINT) FROM dup WHERE dups > 0")
    return O.analysed(view_name, "found AS (" + " UNION ALL ".join(parts) + ")", """kept AS (
  SELECT *, min(phase) OVER (PARTITION BY col, operation) AS best FROM found)""") + """
SELECT 'STEP-' || lpad(CAST(row_number() OVER (ORDER BY phase, place, position, rk) AS VARCHAR), 3, '0') AS step_id,
  operation, col AS "column", parameters, estimate AS affected_rows_estimate FROM kept WHERE phase = best"""


def _plan(name: str, view_name: str, sql: str, ruleset: str = "rules", compat: bool = False, where: str = "") -> None:
    @register(name, f"SELECT * FROM ({sql}) WHERE {where}" if where else sql)
    def run(spark, sf_dir):
        key = O.PROFILED[view_name][0][0]
        plan = propose_plan(Analysis(view(spark, sf_dir, view_name), order_by=key), ruleset, compat)
        plan = plan.select("step_id", "operation", "column", "parameters", "affected_rows_estimate")
        return plan.where(where) if where else plan


_plan("r2_rule_consistency", "clientes", _plan_sql("clientes"), where="operation IN ('trim_text', 'normalize_case')")
_plan("r3_rule_validity", "pedidos", _plan_sql("pedidos"), where="operation IN ('convert_datetime', 'convert_numeric')")
_plan("r4_rule_integrity", "clientes", _plan_sql("clientes"), where="operation = 'clamp_range'")
_plan("r5_rule_completeness", "pedidos", _plan_sql("pedidos"), where="operation = 'fill_missing'")
_plan("r6_fallback_case", "zonas", _plan_sql("zonas"), where="operation = 'normalize_case'")


@register("r7_fallback_trim", O.analysed("clientes") + """
SELECT column_name AS "column", row_count AS affected_rows_estimate, CAST(0.95 AS DOUBLE) AS confidence,
  CAST(0.98 AS DOUBLE) AS confidence_with_issues FROM checked WHERE excess_space > 0""")
def r7(spark, sf_dir):
    """The fallback trims what has excess space. White space also raises an issue, whose surer rule wins where issues are known."""
    analysis = Analysis(view(spark, sf_dir, "clientes"), order_by="id_cliente")

    def trims(found):
        return plan_from_findings(found).where("operation = 'trim_text'").select("column", "affected_rows_estimate", "confidence")

    alone, both = trims(findings(analysis, issues=False)), trims(findings(analysis))
    both = both.select("column", F.col("confidence").alias("confidence_with_issues"))
    return alone.join(both, "column", "left")


_plan("r8_fallback_numeric_compat", "zonas", _plan_sql("zonas", compat=True), compat=True,
      where="operation = 'convert_numeric'")
_plan("r9_fallback_clamp", "zonas", _plan_sql("zonas"), where="operation = 'clamp_range'")
_plan("r10_step_order", "zonas", _plan_sql("zonas"))
_plan("r11_propose_plan", "clientes", _plan_sql("clientes"))
_plan("r11_propose_plan_pedidos", "pedidos", _plan_sql("pedidos"))
_plan("r8_propose_plan_compat", "pedidos", _plan_sql("pedidos", compat=True), compat=True)
_plan("r12_propose_plan_sampled", "clientes", _sampled_sql("clientes"), ruleset="sampled")


@register("r1_rule_uniqueness", _with("actividad", """
SELECT 'STEP-001' AS step_id, 'remove_duplicates' AS operation,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM actividad)) AS affected_rows_estimate FROM actividad"""))
def r1(spark, sf_dir):
    plan = propose_plan(view(spark, sf_dir, "actividad")).where("operation = 'remove_duplicates'")
    return plan.select("step_id", "operation", "affected_rows_estimate")


@register("r13_guardrail", """SELECT 'kept' AS outcome, count(*) AS steps FROM (""" + _plan_sql("clientes") + """)
UNION ALL SELECT 'dropped', CAST(1 AS BIGINT)""")
def r13(spark, sf_dir):
    plan = propose_plan(view(spark, sf_dir, "clientes"))
    foreign = plan.where("step_id = 'STEP-001'").withColumn("operation", F.lit("run_script"))
    kept, dropped = guardrail(plan.unionByName(foreign))
    one = kept.agg(F.lit("kept").alias("outcome"), F.count(F.lit(1)).alias("steps"))
    return one.unionByName(dropped.agg(F.lit("dropped").alias("outcome"), F.count(F.lit(1)).alias("steps")))


# --- E: execution and audit ----------------------------------------------------------------------------


def _client_steps() -> list[Step]:
    return [
        Step("trim_text", "nombre_cliente"),
        Step("normalize_case", "nombre_cliente", {"mode": "title"}),
        Step("convert_numeric", "importe"),
        Step("clamp_range", "importe", {"min_value": 0, "max_value": None}),
        Step("drop_column", "saldo", status="rejected"),
        Step("convert_numeric", "descuento_pct"),
        Step("clamp_range", "descuento_pct", {"min_value": 0.0, "max_value": 100.0}),
        Step("normalize_case", "no_existe", {"mode": "title"}),
        Step("fill_missing", "unidades", {"strategy": "mode"}),
        Step("rename_column", "segmento", {"new_name": "mercado"}),
    ]


_SPACED = r"trim(regexp_replace(nombre_cliente, '\s+', ' ', 'g'))"
_EXECUTED = _with("clientes", f""", numeros AS (SELECT *, {O.number('importe')} AS n, {O.number('descuento_pct')} AS d,
  {_SPACED} AS espaciado, {O.smart_title(_SPACED)} AS titulo FROM clientes)""")
_EXECUTED_FRAME = _EXECUTED + """
SELECT id_cliente, titulo AS nombre_cliente, CASE WHEN n < 0 THEN 0.0 ELSE n END AS importe, segmento AS mercado,
  CASE WHEN d < 0 THEN 0.0 WHEN d > 100 THEN 100.0 ELSE d END AS descuento_pct,
  coalesce(unidades, (SELECT unidades FROM clientes WHERE unidades IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))
    AS unidades, saldo FROM numeros"""


@register("e1_execute_plan", _EXECUTED_FRAME)
def e1(spark, sf_dir):
    return execute_plan(view(spark, sf_dir, "clientes"), _client_steps()).frame


@register("e10_replay_plan", _EXECUTED_FRAME)
def e10(spark, sf_dir):
    return replay_plan(view(spark, sf_dir, "clientes"), plan_to_json(_client_steps())).frame


_AUDIT_SQL = _EXECUTED + """, plain AS (SELECT *, try_cast(importe AS DOUBLE) AS n0 FROM numeros),
counts AS (SELECT count(*) AS rows,
  count(*) FILTER (WHERE nombre_cliente <> espaciado) AS m1, count(*) FILTER (WHERE espaciado <> titulo) AS m2,
  count(*) FILTER (WHERE n0 IS DISTINCT FROM n OR (importe IS NOT NULL AND n IS NULL)) AS m3,
  count(*) FILTER (WHERE n < 0) AS m4, count(*) FILTER (WHERE descuento_pct IS NOT NULL) AS m6,
  count(*) FILTER (WHERE d < 0 OR d > 100) AS m7, count(*) FILTER (WHERE unidades IS NULL) AS m9 FROM plain)
SELECT step_id, operation, status, r AS rows, m AS modified FROM counts, LATERAL (VALUES
  ('STEP-001', 'trim_text', 'applied', rows, m1), ('STEP-002', 'normalize_case', 'applied', rows, m2),
  ('STEP-003', 'convert_numeric', 'applied', rows, m3), ('STEP-004', 'clamp_range', 'applied', rows, m4),
  ('STEP-005', 'drop_column', 'omitted', NULL, NULL), ('STEP-006', 'convert_numeric', 'applied', rows, m6),
  ('STEP-007', 'clamp_range', 'applied', rows, m7), ('STEP-008', 'normalize_case', 'error', NULL, NULL),
  ('STEP-009', 'fill_missing', 'applied', rows, m9), ('STEP-010', 'rename_column', 'applied', rows, rows)
) AS t(step_id, operation, status, r, m)"""


@register("e4_audit_counts", _AUDIT_SQL)
def e4(spark, sf_dir):
    """Covers rejected steps (omitted), a failing step (error) and the changed cells of the others."""
    audit = execute_plan(view(spark, sf_dir, "clientes"), _client_steps()).audit
    return audit.select("step_id", "operation", "status", "rows", "modified")


def _audit_of_write(df, steps, folder, **options):
    """The audit that the write of the clean table has counted."""
    watched = execute_plan(df, steps, **options).watched()
    write_clean(watched.frame, folder)
    return watched.audit()


@register("e4_audit_on_write", _AUDIT_SQL)
def e4_write(spark, sf_dir):
    """The same counts, taken by the write itself."""
    audit = _audit_of_write(view(spark, sf_dir, "clientes"), _client_steps(), shared_folder(spark, "audit"))
    return audit.select("step_id", "operation", "status", "rows", "modified")


@register("e5_audit_on_write_after_dedup", _with("vacias", f"""
, k AS (SELECT clave, estado, prioridad FROM vacias WHERE NOT ({_EMPTY})),
u AS (SELECT DISTINCT estado, prioridad FROM k),
n AS (SELECT (SELECT count(*) FROM vacias) AS read, (SELECT count(*) FROM k) AS kept, (SELECT count(*) FROM u) AS left_over,
  (SELECT count(*) FROM k WHERE clave IS NULL) AS gaps, (SELECT count(*) FROM u WHERE estado <> lower(estado)) AS lowered)
SELECT step_id, r AS rows, m AS modified FROM n, LATERAL (VALUES ('STEP-000', kept, read - kept), ('STEP-001', kept, gaps),
  ('STEP-002', kept, kept), ('STEP-003', left_over, kept - left_over), ('STEP-004', left_over, lowered)) AS t(step_id, r, m)"""))
def e5_write(spark, sf_dir):
    """What lies before the dedup is aggregated, what lies behind it is counted by the write."""
    steps = [Step("fill_missing", "clave"), Step("drop_column", "clave"), Step("remove_duplicates"),
             Step("normalize_case", "estado", {"mode": "lower"})]
    audit = _audit_of_write(view(spark, sf_dir, "vacias"), steps, shared_folder(spark, "audit"), purge_empty_rows=True)
    return audit.select("step_id", "rows", "modified")


@register("e4_audit_large_mapping", """
SELECT count(*) AS rows, count(*) FILTER (WHERE regexp_full_match(p_brand, 'Brand#\\d+') AND p_brand <> 'Brand#11') AS modified
FROM part""")
def e4_large(spark, sf_dir):
    """A dictionary that is joined counts the changed cells only: one brand is mapped to itself."""
    mappings = {f"Brand#{i}": f"Marca {i}" for i in range(100)} | {"Brand#11": "Brand#11"}
    df = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    audit = execute_plan(df, [Step("normalize_category", "p_brand", {"mappings": mappings})]).audit
    return audit.select("rows", "modified")


_GAPS = """SELECT DISTINCT l_suppkey AS proveedor, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS cantidad,
  CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount END AS descuento,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END AS impuesto FROM lineitem"""


@register("e1_dedup_and_three_medians", f"""WITH u AS ({_GAPS}) SELECT proveedor,
  coalesce(cantidad, (SELECT median(cantidad) FROM u)) AS cantidad,
  coalesce(descuento, (SELECT median(descuento) FROM u)) AS descuento,
  coalesce(impuesto, (SELECT median(impuesto) FROM u)) AS impuesto FROM u""")
def e1_medians(spark, sf_dir):
    """Three statistics behind a dedup: one barrier for all of them."""
    df = spark.sql(_GAPS.replace("DISTINCT ", "").replace("lineitem", "{lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    steps = [Step("remove_duplicates")] + [
        Step("fill_missing", c, {"strategy": "median"}) for c in ("cantidad", "descuento", "impuesto")
    ]
    return execute_plan(df, steps).frame


@register("e5_audit_dedup", _with("actividad", """, s AS (SELECT count(*) AS n,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM actividad)) AS u FROM actividad)
SELECT 'remove_duplicates' AS operation, u AS rows, n - u AS modified FROM s"""))
def e5(spark, sf_dir):
    audit = execute_plan(view(spark, sf_dir, "actividad"), [Step("remove_duplicates")]).audit
    return audit.select("operation", "rows", "modified")


@register("e6_audit_datetime", _with("pedidos", f"""
SELECT 'convert_datetime' AS operation, count({O.date('fecha_pedido')}) AS converted,
  count(*) FILTER (WHERE fecha_pedido IS NOT NULL AND ({O.date('fecha_pedido')}) IS NULL) AS invalid FROM pedidos"""))
def e6(spark, sf_dir):
    audit = execute_plan(view(spark, sf_dir, "pedidos"), [Step("convert_datetime", "fecha_pedido")]).audit
    return audit.select("operation", "converted", "invalid")


@register("e7_audit_clamp", _with("clientes", """
SELECT count(*) FILTER (WHERE saldo < 0) AS modified,
  'clamp_range · saldo: ' || count(*) FILTER (WHERE saldo < 0) || ' celda(s) llevadas a [0, inf]' AS message FROM clientes"""))
def e7(spark, sf_dir):
    steps = [Step("clamp_range", "saldo", {"min_value": 0, "max_value": None})]
    return execute_plan(view(spark, sf_dir, "clientes"), steps).audit.select("modified", "message")


@register("e9_execution_summary", _with("actividad", """
SELECT count(*) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT * FROM actividad)) AS rows_after,
  CAST(2 AS BIGINT) AS columns_before, CAST(2 AS BIGINT) AS columns_after, CAST(2 AS BIGINT) AS applied_steps,
  CAST(1 AS BIGINT) AS skipped_steps, CAST(1 AS BIGINT) AS failed_steps, 'completed_with_errors' AS status FROM actividad"""))
def e9(spark, sf_dir):
    steps = [Step("remove_duplicates"), Step("trim_text", "tipo"), Step("drop_column", "tipo", status="rejected"),
             Step("normalize_case", "tipo", {"mode": "camel"})]
    return execute_plan(view(spark, sf_dir, "actividad"), steps).summary().drop("fingerprint_before", "fingerprint_after")


@register("e9_run_plan", ORACLES["e9_execution_summary"])
def e9_run(spark, sf_dir):
    """The same, with the clean table written and summed up from what was written."""
    steps = [Step("remove_duplicates"), Step("trim_text", "tipo"), Step("drop_column", "tipo", status="rejected"),
             Step("normalize_case", "tipo", {"mode": "camel"})]
    _, summary = run_plan(view(spark, sf_dir, "actividad"), steps, shared_folder(spark, "run"))
    return summary.drop("fingerprint_before", "fingerprint_after", "path", "started_at", "seconds")


@register("e11_plan_from_data", _with("pedidos", f"""
SELECT id_pedido, strftime({O.date('fecha_pedido')}, '%Y-%m-%d') AS fecha_pedido,
  CASE WHEN trim(prioridad) <> '' THEN {O.smart_title('prioridad')} ELSE 'Desconocido' END AS prioridad, estado,
  coalesce(total, (SELECT median(total) FROM pedidos)) AS total FROM pedidos"""))
def e11(spark, sf_dir):
    """Propose, approve and execute on the whole table; every cleaned value is compared."""
    df = view(spark, sf_dir, "pedidos")
    steps = collect_steps(propose_plan(Analysis(df, order_by="id_pedido")))
    clean = execute_plan(df, steps, order_by="id_pedido").frame
    return clean.select("id_pedido", "fecha_pedido", "prioridad", "estado", "total")


@register("e10_replay_stream", """
SELECT s_suppkey, upper(s_name) AS s_name, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier""")
def e10_stream(spark, sf_dir):
    """The same operators on a stream of the table's files, run until the input is used up."""
    schema = table(spark, sf_dir, "supplier").schema
    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", "supplier.parquet").parquet(sf_dir)
        .select("s_suppkey", "s_name", "s_acctbal")
    )
    steps = [Step("normalize_case", "s_name", {"mode": "upper"}),
             Step("clamp_range", "s_acctbal", {"min_value": 0, "max_value": None})]
    folder = shared_folder(spark, "stream")
    query = (
        replay_stream(stream, steps).writeStream.format("parquet").trigger(availableNow=True)
        .option("checkpointLocation", f"{folder}/state").start(f"{folder}/rows")
    )
    query.awaitTermination()
    return scan_parquet(spark, f"{folder}/rows")


_EVENTS_WITH_GAPS = ["event_id", "CAST(ts AS TIMESTAMP) AS ts", "user_id", "upper(event_type) AS event_type", "IF(event_id % 9 = 0, NULL, value) AS value"]


def _streamed(spark, sf_dir, steps, watermark=None):
    """The events as a stream through a plan, run until the input is used up."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    cleaned = replay_stream(stream.selectExpr(*_EVENTS_WITH_GAPS), plan_to_json(steps), watermark)
    folder = shared_folder(spark, "stream")
    query = (cleaned.writeStream.format("parquet").trigger(availableNow=True)
             .option("checkpointLocation", f"{folder}/state").start(f"{folder}/rows"))
    query.awaitTermination()
    return scan_parquet(spark, f"{folder}/rows")


@register("e10_fitted_stream", """
WITH e AS (SELECT event_id, user_id, lower(event_type) AS event_type, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value FROM events)
SELECT event_id, user_id, event_type, least(coalesce(value, (SELECT median(value) FROM e)), 90.0) AS value FROM e""")
def e10_fitted(spark, sf_dir):
    """A plan with a median, fitted on the table and replayed on a stream of it."""
    steps = fit_plan(table(spark, sf_dir, "events").selectExpr(*_EVENTS_WITH_GAPS), [
        Step("fill_missing", "value", {"strategy": "median"}), Step("normalize_case", "event_type", {"mode": "lower"}),
        Step("clamp_range", "value", {"min_value": None, "max_value": 90.0}),
    ])
    return _streamed(spark, sf_dir, steps).select("event_id", "user_id", "event_type", "value")


@register("e10_stream_without_duplicates", "SELECT DISTINCT user_id, lower(event_type) AS event_type FROM events")
def e10_dedup(spark, sf_dir):
    steps = [Step("normalize_case", "event_type", {"mode": "lower"}),
             Step("remove_duplicates", parameters={"subset_columns": ["user_id", "event_type"]}), Step("drop_column", "value")]
    return _streamed(spark, sf_dir, steps, ("ts", "36500 days")).select("user_id", "event_type")


# --- K: KPIs -----------------------------------------------------------------------------------------


def _kpi_rows(*rows: tuple[str, str, str]) -> str:
    """(kpi_id, number, direction) expressions over the one-row relation ``a``."""
    return " UNION ALL ".join(
        f"SELECT '{i}' AS kpi_id, round_even(CAST({n} AS DOUBLE), 2) AS numeric_value, {d} AS change_direction FROM a"
        for i, n, d in rows
    )


def _kpis(report) -> DataFrame:
    rounded = numbers.round_even(F.col("numeric_value"), 2).alias("numeric_value")
    return report.kpis.select("kpi_id", rounded, "change_direction")


@register("k1_k5_contact_center", _with("llamadas", """, a AS (SELECT count(*) AS n, count(DISTINCT agente) AS ag,
  avg(aht_segundos) AS aht, avg(score_calidad) AS q, avg(conversion_pct) AS c,
  count(*) FILTER (WHERE lower(absentismo) IN ('si', 'yes', 'true', '1')) AS ab FROM llamadas) """) + _kpi_rows(
    ("kpi-agents", "ag", "NULL"),
    ("kpi-aht", "round_even(aht, 1)", "CASE WHEN aht <= 450 THEN 'positive' ELSE 'neutral' END"),
    ("kpi-quality", "round_even(q, 1)", "CASE WHEN q >= 80 THEN 'positive' ELSE 'negative' END"),
    ("kpi-conv", "round_even(c, 1)", "CASE WHEN c >= 10 THEN 'positive' ELSE 'neutral' END"),
    ("kpi-absenteeism", "round_even(ab / n * 100, 1)",
     "CASE WHEN round_even(ab / n * 100, 1) > 15 THEN 'negative' ELSE 'positive' END")))
def k_contact(spark, sf_dir):
    return _kpis(kpi.kpi_report(view(spark, sf_dir, "llamadas")))


@register("k7_k10_sales", _with("ventas", """, a AS (SELECT count(*) AS n,
  sum(coalesce(precio, 0) * coalesce(cantidad, 1)) AS rev, avg(coalesce(precio, 0)) AS t FROM ventas) """) + _kpi_rows(
    ("kpi-revenue", "rev", "NULL"), ("kpi-ticket", "t", "NULL"), ("kpi-tx", "n", "NULL"),
    ("kpi-topprod", "NULL", "NULL")))
def k_sales(spark, sf_dir):
    return _kpis(kpi.kpi_report(view(spark, sf_dir, "ventas")))


@register("k10_top_product", _with("ventas", """
SELECT producto AS value FROM ventas GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1"""))
def k10(spark, sf_dir):
    return kpi.kpi_report(view(spark, sf_dir, "ventas")).kpis.where("kpi_id = 'kpi-topprod'").select("value")


@register("k11_k14_people", _with("plantilla", """, a AS (SELECT count(DISTINCT empleado) AS e, avg(salario) AS s,
  avg(productividad) AS p, sum(absentismo_dias) AS d FROM plantilla) """) + _kpi_rows(
    ("kpi-emp-count", "e", "NULL"), ("kpi-avg-salary", "s", "NULL"),
    ("kpi-avg-prod", "round_even(p, 1)", "CASE WHEN p >= 85 THEN 'positive' ELSE 'neutral' END"),
    ("kpi-total-abs", "d", "CASE WHEN d > 10 THEN 'negative' ELSE 'positive' END")))
def k_people(spark, sf_dir):
    return _kpis(kpi.kpi_report(view(spark, sf_dir, "plantilla")))


@register("k15_general", "WITH a AS (SELECT count(*) AS n FROM orders) " + _kpi_rows(
    ("kpi-gen-rows", "n", "NULL"), ("kpi-gen-cols", "6", "NULL")))
def k_general(spark, sf_dir):
    return _kpis(kpi.kpi_report(table(spark, sf_dir, "orders")))


@register("k12_k14_value_text", _with("plantilla", """
SELECT 'kpi-avg-salary' AS kpi_id, translate(format('{:,.2f}', avg(salario)), ',.', '.,') || ' €' AS value FROM plantilla
UNION ALL SELECT 'kpi-emp-count', count(DISTINCT empleado) || ' empleados' FROM plantilla
UNION ALL SELECT 'kpi-avg-prod', printf('%.1f', round_even(avg(productividad), 1)) || '%' FROM plantilla
UNION ALL SELECT 'kpi-total-abs', CAST(sum(absentismo_dias) AS BIGINT) || ' días' FROM plantilla"""))
def k_text(spark, sf_dir):
    return kpi.kpi_report(view(spark, sf_dir, "plantilla")).kpis.select("kpi_id", "value")


def _breakdown(name: str, view_name: str, column: str) -> None:
    @register(name, _with(view_name, f"""
SELECT {column} AS category_name, count(*) AS count,
  round_even(count(*) / (SELECT count(*) FROM {view_name}) * 100, 1) AS percentage
FROM {view_name} WHERE {column} IS NOT NULL GROUP BY 1"""))
    def run(spark, sf_dir):
        return kpi.kpi_report(view(spark, sf_dir, view_name)).breakdown


_breakdown("k6_breakdown_channel", "ventas", "canal")
_breakdown("k6_breakdown_campaign", "llamadas", "campana")
_breakdown("k6_breakdown_department", "plantilla", "departamento")


@register("k17_narrative", _with("plantilla", """
SELECT 'Plantilla: ' || count(DISTINCT empleado) || ' empleados; Salario medio: '
  || translate(format('{:,.2f}', avg(salario)), ',.', '.,') || ' €; Productividad media: '
  || printf('%.1f', round_even(avg(productividad), 1)) || '%; Días de ausencia: '
  || CAST(sum(absentismo_dias) AS BIGINT) || ' días.' AS executive_summary FROM plantilla"""))
def k17(spark, sf_dir):
    return kpi.kpi_report(view(spark, sf_dir, "plantilla")).narrative


@register("k17_recommendations", _with("llamadas", """, a AS (SELECT avg(aht_segundos) AS aht, avg(score_calidad) AS q,
  avg(conversion_pct) AS c, round_even(count(*) FILTER (WHERE lower(absentismo) IN ('si', 'yes', 'true', '1')) / count(*) * 100, 1) AS ab
  FROM llamadas)
SELECT 'kpi-aht' AS kpi_id, 'neutral' AS change_direction FROM a WHERE aht > 450
UNION ALL SELECT 'kpi-quality', 'negative' FROM a WHERE q < 80
UNION ALL SELECT 'kpi-conv', 'neutral' FROM a WHERE c < 10
UNION ALL SELECT 'kpi-absenteeism', 'negative' FROM a WHERE ab > 15"""))
def k17_recommendations(spark, sf_dir):
    """One row for each KPI that misses its threshold."""
    found = kpi.kpi_report(view(spark, sf_dir, "llamadas")).recommendations
    return found.where(F.length("recommendation") > 20).select("kpi_id", "change_direction")


# --- A: privacy --------------------------------------------------------------------------------------


@register("a1_mask_by_hint", """
SELECT c_custkey, '[NOMBRE]' AS c_name, c_acctbal, c_mktsegment FROM customer""")
def a1(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return mask_by_hint(df, {"c_name": "name", "c_acctbal": "currency", "c_custkey": "id"})


@register("a2_mask_embedded", f"SELECT doc_id, {_MASKED} AS text FROM documents")
def a2(spark, sf_dir):
    return mask_embedded(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"])


@register("a3_masked_sample", """
SELECT c_custkey, '[NOMBRE]' AS c_name, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 3""")
def a3(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return masked_sample(df, {"c_name": "name"}, order_by="c_custkey")
