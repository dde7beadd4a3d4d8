"""Deterministic dirty views over the clean driver tables.

One SQL text serves Spark and the oracle; only number and date formatting differ by dialect.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_SPARK = {
    "us": "format_number({x}, 2)",
    "plain": "format_string('%.2f', {x})",
    "iso": "date_format({x}, 'yyyy-MM-dd')",
    "dmy": "date_format({x}, 'dd/MM/yyyy')",
    "ymd": "date_format({x}, 'yyyy/MM/dd')",
}
_DUCK = {
    "us": "format('{{:,.2f}}', {x})",
    "plain": "printf('%.2f', {x})",
    "iso": "strftime({x}, '%Y-%m-%d')",
    "dmy": "strftime({x}, '%d/%m/%Y')",
    "ymd": "strftime({x}, '%Y/%m/%d')",
}

_EU = "translate(<us:c_acctbal>, ',.', '.,')"

VIEWS = {
    # name: (source tables, text)
    "clientes": (["customer"], f"""
SELECT c_custkey AS id_cliente,
  CASE c_custkey % 3 WHEN 0 THEN concat('  ', replace(c_name, '#', '  '), ' ')
    WHEN 1 THEN upper(c_name) ELSE c_name END AS nombre_cliente,
  CASE c_custkey % 5 WHEN 0 THEN concat({_EU}, ' €') WHEN 1 THEN concat('$', <us:c_acctbal>)
    WHEN 2 THEN <plain:c_acctbal> WHEN 3 THEN 'N/D' ELSE {_EU} END AS importe,
  CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN concat(c_mktsegment, ' ')
    ELSE c_mktsegment END AS segmento,
  concat(CAST(c_nationkey * 6 - 20 AS STRING), '%') AS descuento_pct,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_nationkey - 3 END AS unidades,
  c_acctbal AS saldo
FROM @customer"""),
    "pedidos": (["orders"], """
SELECT o_orderkey AS id_pedido,
  CASE WHEN o_orderkey % 8 < 5 THEN <iso:o_orderdate> WHEN o_orderkey % 8 = 5 THEN <dmy:o_orderdate>
    WHEN o_orderkey % 8 = 6 THEN <ymd:o_orderdate> ELSE 'invalid_date' END AS fecha_pedido,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN ' '
    ELSE o_orderpriority END AS prioridad,
  o_orderstatus AS estado,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS total,
  CASE o_orderkey % 6 WHEN 0 THEN 'Si' WHEN 1 THEN 'no' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0'
    WHEN 4 THEN 'S' ELSE 'N' END AS urgente
FROM @orders"""),
    "vacias": (["orders"], """
SELECT CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey AS STRING) END AS clave,
  CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE o_orderstatus END AS estado,
  CASE WHEN o_orderkey % 11 = 0 THEN 'undefined' WHEN o_orderkey % 13 = 0 THEN NULL
    ELSE o_orderpriority END AS prioridad
FROM @orders"""),
    "piezas": (["part"], """
SELECT p_partkey AS id_pieza,
  CASE WHEN p_partkey % 3 = 0 THEN concat(' ', upper(p_name), ' SA ')
    WHEN p_partkey % 3 = 1 THEN concat(p_name, ' ab-', CAST(p_size AS STRING))
    ELSE p_name END AS nombre
FROM @part"""),
    "zonas": (["part"], """
SELECT p_partkey AS id_pieza, upper(replace(p_brand, '#', '-')) AS marca, p_size - 25 AS margen,
  concat(CAST(p_size AS STRING), ' eur') AS tarifa, p_type AS gama
FROM @part"""),
    "ventas": (["lineitem", "part"], """
SELECT l_orderkey AS id_pedido, p_name AS producto, l_returnflag AS canal,
  CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_extendedprice END AS precio,
  CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_quantity END AS cantidad
FROM @lineitem JOIN @part ON l_partkey = p_partkey"""),
    "llamadas": (["events"], """
SELECT user_id AS agente, event_type AS campana, value AS aht_segundos,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE value / 2 END AS score_calidad,
  value / 10 AS conversion_pct,
  CASE WHEN event_id % 5 = 0 THEN 'Si' WHEN event_id % 5 = 1 THEN 'YES' ELSE 'No' END AS absentismo
FROM @events"""),
    "plantilla": (["customer"], """
SELECT c_name AS empleado, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS departamento,
  c_acctbal AS salario, CAST(c_nationkey * 5 AS DOUBLE) AS productividad,
  c_nationkey AS absentismo_dias
FROM @customer"""),
    "productos": (["part"], """
SELECT p_partkey AS id_producto,
  CASE p_partkey % 40 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat('  ', p_name, ' ')
    WHEN 2 THEN concat(split_part(p_name, ' ', 2), ' - ', split_part(p_name, ' ', 1))
    WHEN 3 THEN concat(left(p_name, 2), 'x', substr(p_name, 4)) WHEN 4 THEN concat(left(p_name, 3), substr(p_name, 5))
    WHEN 5 THEN concat(left(p_name, 5), substr(p_name, 7, 1), substr(p_name, 6, 1), substr(p_name, 8))
    WHEN 6 THEN replace(p_name, 'a', 'á') WHEN 7 THEN NULL WHEN 8 THEN '-' ELSE p_name END AS nombre,
  CASE WHEN p_partkey % 50 = 9 THEN lower(p_brand) ELSE p_brand END AS marca
FROM @part"""),
    "actividad": (["events"], "SELECT user_id AS usuario, event_type AS tipo FROM @events"),
}


def _render(text: str, dialect: dict[str, str]) -> str:
    out = ""
    while "<" in text:
        head, rest = text.split("<", 1)
        if ":" in rest.split(">", 1)[0] and rest.split(":", 1)[0] in dialect:
            call, text = rest.split(">", 1)
            name, argument = call.split(":", 1)
            out += head + dialect[name].format(x=argument)
        else:
            out, text = out + head + "<", rest
    return out + text


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, text = VIEWS[name]
    text = _render(text, _SPARK)
    frames = {}
    for t in tables:
        text = text.replace(f"@{t}", "{" + t + "}")
        frames[t] = table(spark, sf_dir, t)
    return spark.sql(text, **frames)


def cte(name: str) -> str:
    """The same view as a DuckDB common table expression."""
    tables, text = VIEWS[name]
    text = _render(text, _DUCK)
    for t in tables:
        text = text.replace(f"@{t}", t)
    return f"{name} AS ({text})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that every executor can reach: below ``spark.checkpoint.dir``.

    A temporary folder is only used where Spark runs inside this process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    stamp = f"{name}-{os.urandom(6).hex()}"
    if base:
        return f"{base.rstrip('/')}/{stamp}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("INVALID_PARAMETER: set spark.checkpoint.dir on a cluster")
    return f"{tempfile.mkdtemp(prefix='tersa-')}/{stamp}"
