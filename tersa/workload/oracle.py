"""SQL building blocks for the oracle texts: the same meanings, said in DuckDB's words."""

from __future__ import annotations

from tersa.functions import vocabulary as V
from tersa.workload.views import cte


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def number(x: str) -> str:
    bare = rf"regexp_replace(regexp_replace({x}, '[€$%\s]', '', 'g'), '(?i)\b(usd|eur)\b', '', 'g')"
    return rf"""CASE
      WHEN regexp_full_match({bare}, '[+-]?\d{{1,3}}(\.\d{{3}})+(,\d+)?|[+-]?\d*,\d+')
        THEN try_cast(replace(replace({bare}, '.', ''), ',', '.') AS DOUBLE)
      WHEN regexp_full_match({bare}, '[+-]?\d{{1,3}}(,\d{{3}})+(\.\d+)?')
        THEN try_cast(replace({bare}, ',', '') AS DOUBLE)
      WHEN regexp_full_match({bare}, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?')
        THEN try_cast({bare} AS DOUBLE) END"""


def marker(x: str) -> str:
    return rf"(lower(trim({x})) IN ({quoted(V.MISSING_MARKERS)}) OR regexp_full_match({x}, '[-_—–\s]+'))"


def symbol(x: str) -> str:
    return f"regexp_matches({x}, '€|\\$|%|USD|EUR')"


def caps(x: str) -> str:
    return f"(length(trim({x})) > 2 AND trim({x}) = upper(trim({x})) AND trim({x}) <> lower(trim({x})))"


def excess(x: str) -> str:
    return f"({x} <> trim({x}) OR contains({x}, '  '))"


def date(x: str) -> str:
    return (
        rf"CASE WHEN regexp_full_match({x}, '\d{{4}}-\d{{1,2}}-\d{{1,2}}') THEN try_strptime({x}, '%Y-%m-%d') "
        rf"WHEN regexp_full_match({x}, '\d{{4}}/\d{{1,2}}/\d{{1,2}}') THEN try_strptime({x}, '%Y/%m/%d') "
        rf"WHEN regexp_full_match({x}, '\d{{1,2}}/\d{{1,2}}/\d{{4}}') THEN "
        rf"coalesce(try_strptime({x}, '%d/%m/%Y'), try_strptime({x}, '%m/%d/%Y')) END"
    )


def date_class(x: str) -> str:
    return (
        rf"CASE WHEN ({date(x)}) IS NULL THEN NULL WHEN regexp_matches({x}, '^\d{{4}}-') THEN 1 "
        rf"WHEN regexp_matches({x}, '^\d{{4}}/') THEN 2 ELSE 4 END"
    )


def smart_title(x: str) -> str:
    token = (
        f"CASE WHEN upper(t) IN ({quoted(V.ACRONYMS)}) "
        f"OR regexp_full_match(t, '{V.CODE_TOKEN}') THEN upper(t) "
        "ELSE upper(left(t, 1)) || lower(substr(t, 2)) END"
    )
    return f"array_to_string(list_transform(string_split(trim({x}), ' '), lambda t: {token}), ' ')"


def name_like(words=(), prefixes=(), suffixes=(), exact=()) -> str:
    """Test on ``lower(column_name)`` as an OR of plain comparisons."""
    n = "lower(column_name)"
    tests = [f"contains({n}, '{w}')" for w in words]
    tests += [f"starts_with({n}, '{p}')" for p in prefixes]
    tests += [f"ends_with({n}, '{s}')" for s in suffixes]
    tests += [f"{n} = '{e}'" for e in exact]
    return "(" + " OR ".join(tests) + ")"


PERCENT_NAME = name_like((), V.PERCENT_PREFIXES, V.PERCENT_SUFFIXES, V.PERCENT_NAMES)

# Columns of the views that are profiled: name -> kind, in table order; the first is the row order.
PROFILED = {
    "clientes": [
        ("id_cliente", "number"), ("nombre_cliente", "text"), ("importe", "text"),
        ("segmento", "text"), ("descuento_pct", "text"), ("unidades", "number"), ("saldo", "number"),
    ],
    "pedidos": [
        ("id_pedido", "number"), ("fecha_pedido", "text"), ("prioridad", "text"),
        ("estado", "text"), ("total", "number"), ("urgente", "text"),
    ],
    "zonas": [
        ("id_pieza", "number"), ("marca", "text"), ("margen", "number"), ("tarifa", "text"),
        ("gama", "text"),
    ],
}


def cells(view: str) -> str:
    """(position, column_name, kind, txt, num, cls, row_id), one row per cell."""
    columns = PROFILED[view]
    row_id = columns[0][0]
    parts = []
    for i, (name, kind) in enumerate(columns):
        num = f"CAST({name} AS DOUBLE)" if kind == "number" else number(f"trim({name})")
        cls = date_class(f"trim({name})") if kind == "text" else "NULL"
        parts.append(
            f"SELECT {i} AS position, '{name}' AS column_name, '{kind}' AS kind, "
            f"CAST({name} AS VARCHAR) AS txt, {num} AS num, CAST({cls} AS INTEGER) AS cls, "
            f"{row_id} AS row_id FROM {view}"
        )
    return "cells AS (" + " UNION ALL ".join(parts) + ")"


FACTS = f"""counted AS (
  SELECT position, column_name, kind, count(*) AS row_count,
    count(*) FILTER (WHERE txt IS NULL OR trim(txt) = '') AS nulls,
    count(txt) AS filled,
    count(DISTINCT txt) FILTER (WHERE trim(txt) <> '') AS unique_count,
    count(*) FILTER (WHERE trim(txt) <> '' AND NOT {marker('txt')}) AS plain,
    count(*) FILTER (WHERE trim(txt) <> '' AND num IS NOT NULL) AS parsed,
    count(*) FILTER (WHERE trim(txt) <> '' AND lower(txt) NOT IN ({quoted(V.DATE_SAMPLE_ERROR_TOKENS)})) AS date_pool,
    count(*) FILTER (WHERE trim(txt) <> '' AND lower(txt) NOT IN ({quoted(V.BOOLEAN_TOKENS)})) AS not_boolean,
    greatest(count(*) FILTER (WHERE cls = 1), count(*) FILTER (WHERE cls = 2),
      count(*) FILTER (WHERE cls = 4)) AS standard_dates,
    coalesce(bool_or(contains(txt, '@')), false) AS has_at,
    coalesce(bool_or(contains(txt, '%')), false) AS has_percent,
    coalesce(bool_or(regexp_matches(txt, '€|\\$|USD|EUR')), false) AS has_currency,
    coalesce(bool_or(kind = 'text' AND regexp_full_match(trim(txt), '{V.CODE_TOKEN}')), false) AS has_code,
    count(*) FILTER (WHERE {excess('txt')}) AS excess_space,
    count(*) FILTER (WHERE kind = 'text' AND {caps('txt')}) AS all_caps,
    count(DISTINCT trim(txt)) - count(DISTINCT lower(trim(txt))) AS variants,
    count(*) FILTER (WHERE txt IS NOT NULL AND ({marker('txt')} OR {symbol('txt')} OR num IS NULL)) AS dirty,
    coalesce(bool_or(kind = 'text' AND ({marker('txt')} OR regexp_matches(txt, '€|\\$|%|usd|eur'))), false) AS marked,
    count(*) FILTER (WHERE num < 0) AS negatives,
    count(*) FILTER (WHERE num > 100) AS over_hundred,
    min(num) AS lo, max(num) AS hi, avg(num) AS mean, median(num) AS med, stddev_samp(num) AS sd,
    count(num) AS numbers,
    sum(CASE WHEN kind = 'number' THEN CASE WHEN txt IS NULL THEN 0 ELSE 8 END
      ELSE coalesce(strlen(txt), 0) END) AS text_bytes
  FROM cells GROUP BY position, column_name, kind),
typed AS (
  SELECT *, CASE WHEN row_count = nulls THEN 'text' WHEN kind = 'number' THEN 'numeric'
    WHEN plain > 0 AND parsed = plain OR parsed > 0 AND parsed >= (row_count - nulls) * 0.5 THEN 'numeric'
    WHEN date_pool > 0 AND standard_dates > date_pool * 0.6 THEN 'datetime'
    WHEN not_boolean = 0 THEN 'boolean'
    WHEN unique_count + CASE WHEN nulls > 0 THEN 1 ELSE 0 END < row_count * 0.25
      AND unique_count + CASE WHEN nulls > 0 THEN 1 ELSE 0 END <= 30 THEN 'categorical'
    ELSE 'text' END AS inferred_type FROM counted),
facts AS (
  SELECT *, CASE WHEN row_count = nulls THEN 'unknown'
    WHEN contains(lower(column_name), 'email') OR has_at THEN 'email'
    WHEN has_percent OR {PERCENT_NAME} THEN 'percentage'
    WHEN {name_like(V.CURRENCY_WORDS)} OR has_currency THEN 'currency'
    WHEN {name_like(V.DATE_WORDS)} OR inferred_type = 'datetime' THEN 'date'
    WHEN {name_like(V.ID_WORDS_PROFILE, V.ID_PREFIXES, V.ID_SUFFIXES)} OR has_code THEN 'id'
    WHEN {name_like(V.PHONE_WORDS)} THEN 'phone'
    WHEN {name_like(V.NAME_WORDS)} THEN 'name'
    WHEN {name_like(V.LOCATION_WORDS)} THEN 'location'
    ELSE 'unknown' END AS semantic_hint FROM typed),
checked AS (
  SELECT *, nulls AS n_nulls, excess_space AS n_whitespace,
    CASE WHEN NOT (semantic_hint = 'id' OR {name_like(V.ID_WORDS_QUALITY, V.ID_PREFIXES, V.ID_SUFFIXES)})
      AND (inferred_type IN ('text', 'categorical') OR semantic_hint = 'name')
      THEN greatest(variants, all_caps) ELSE 0 END AS n_case,
    CASE WHEN semantic_hint = 'date' OR inferred_type = 'datetime' THEN filled - standard_dates ELSE 0 END AS n_dates,
    CASE WHEN inferred_type = 'numeric' OR semantic_hint IN ('currency', 'percentage')
      OR {name_like(V.QUANTITY_WORDS)} THEN dirty ELSE 0 END AS n_numbers,
    CASE WHEN semantic_hint = 'percentage' THEN negatives + over_hundred ELSE 0 END AS n_percent_range,
    CASE WHEN semantic_hint <> 'percentage' AND (semantic_hint = 'currency' OR {name_like(V.POSITIVE_WORDS)})
      THEN negatives ELSE 0 END AS n_negatives
  FROM facts)"""

# kind -> (dimension, order of the dimension, order within a column)
_KINDS = {
    "nulls": ("completeness", 1, 1), "whitespace": ("consistency", 3, 1),
    "case": ("consistency", 3, 2), "dates": ("validity", 4, 1), "numbers": ("validity", 4, 2),
    "percent_range": ("integrity", 5, 1), "negatives": ("integrity", 5, 2),
}


def dup_cte(view: str) -> str:
    return (
        f"dup AS (SELECT (SELECT count(*) FROM {view}) AS row_total, (SELECT count(*) FROM {view}) - "
        f"(SELECT count(*) FROM (SELECT DISTINCT * FROM {view})) AS dups)"
    )


ISSUES = "issues AS (" + " UNION ALL ".join(
    [
        f"SELECT {dim_no} AS d, position AS p, {within} AS w, '{dim}' AS dimension, column_name AS \"column\", "
        f"'{kind}' AS kind, n_{kind} AS affected_rows, row_count AS row_total FROM checked WHERE n_{kind} > 0"
        for kind, (dim, dim_no, within) in _KINDS.items()
    ]
    + ["SELECT 2, -1, 1, 'uniqueness', NULL, 'duplicates', dups, row_total FROM dup WHERE dups > 0"]
) + ")"


def analysed(view: str, *more: str) -> str:
    """WITH clause from the view to the checked facts and issues."""
    return "WITH " + ", ".join([cte(view), cells(view), FACTS, dup_cte(view), ISSUES, *more])


def scores(view: str) -> str:
    """One-row CTE ``scored`` with the five dimension scores."""
    def share(bad: str, whole: str) -> str:
        return f"round_even(greatest(0.0, 100.0 * (1.0 - CAST({bad} AS DOUBLE) / {whole})), 2)"

    width = len(PROFILED[view])
    return (
        "summed AS (SELECT sum(n_nulls) AS b1, sum(n_whitespace + n_case) AS b3, "
        "sum(n_dates + n_numbers) AS b4, sum(n_percent_range + n_negatives) AS b5 FROM checked), "
        f"scored AS (SELECT {share('b1', f'(row_total * {width})')} AS completeness, "
        f"{share('dups', 'row_total')} AS uniqueness, {share('b3', f'(row_total * {width})')} AS consistency, "
        f"{share('b4', f'(row_total * {width})')} AS validity, {share('b5', 'row_total')} AS integrity "
        "FROM summed, dup)"
    )


OVERALL = (
    "round_even(greatest(0.0, least(100.0, CAST(0.30 AS DOUBLE) * completeness + CAST(0.25 AS DOUBLE) * validity "
    "+ CAST(0.20 AS DOUBLE) * consistency + CAST(0.15 AS DOUBLE) * uniqueness + CAST(0.10 AS DOUBLE) * integrity)), 1)"
)
