"""Domain KPIs of a clean table: one wide aggregate, one category breakdown, a short narrative."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersa.functions import numbers, text
from tersa.operators.catalog import NUMBER, TEXT, column_kinds
from tersa.operators.selection import most_frequent

# Domains in the order they are tried, with the name parts that decide.
DOMAIN_WORDS = {
    "contact_center": ["aht", "campana", "llamadas"],
    "sales": ["precio", "producto", "comercial"],
    "people_analytics": ["empleado", "salario", "departamento"],
}
# Name parts of the column that plays a role; the first column that matches is taken.
ROLE_WORDS = {
    "contact_center": {
        "agent": ["agente"], "aht": ["aht"], "quality": ["calidad", "score"],
        "conversion": ["conversion", "pct"], "absence": ["absentismo"], "category": ["campana"],
    },
    "sales": {
        "price": ["precio", "importe"], "quantity": ["cantidad", "unidades"],
        "product": ["producto"], "category": ["canal"],
    },
    "people_analytics": {
        "employee": ["empleado", "nombre"], "salary": ["salario", "sueldo"],
        "productivity": ["productividad"], "absence": ["absentismo"],
        "category": ["departamento", "area"],
    },
    "general": {},
}
# Thresholds of the direction labels.
AHT_GOOD_UP_TO, QUALITY_GOOD_FROM, CONVERSION_GOOD_FROM = 450.0, 80.0, 10.0
ABSENCE_RATE_BAD_OVER, PRODUCTIVITY_GOOD_FROM, ABSENCE_DAYS_BAD_OVER = 15.0, 85.0, 10.0

# The ids of the KPIs.
TITLES = {
    "kpi-agents": ("Agentes", "agentes distintos", "operaciones"),
    "kpi-aht": ("AHT medio", "segundos por llamada", "operaciones"),
    "kpi-quality": ("Calidad media", "media de las auditorías", "calidad"),
    "kpi-conv": ("Conversión media", "media de la tasa", "financiero"),
    "kpi-absenteeism": ("Absentismo", "registros con ausencia", "operaciones"),
    "kpi-revenue": ("Facturación", "precio por cantidad", "financiero"),
    "kpi-ticket": ("Ticket medio", "precio medio por línea", "financiero"),
    "kpi-tx": ("Transacciones", "registros limpios", "operaciones"),
    "kpi-topprod": ("Producto más vendido", "el más repetido", "operaciones"),
    "kpi-emp-count": ("Plantilla", "personas distintas", "operaciones"),
    "kpi-avg-salary": ("Salario medio", "media mensual", "financiero"),
    "kpi-avg-prod": ("Productividad media", "media de la plantilla", "operaciones"),
    "kpi-total-abs": ("Días de ausencia", "suma del periodo", "calidad"),
    "kpi-gen-rows": ("Registros", "filas limpias", "operaciones"),
    "kpi-gen-cols": ("Columnas", "", "general"),
}

# What a KPI that is not on its good side calls for, with the threshold that it missed.
ADVICE = {
    "kpi-aht": ("Acortar las llamadas: el tiempo medio pasa de", AHT_GOOD_UP_TO),
    "kpi-quality": ("Reforzar la formación: la calidad media no llega a", QUALITY_GOOD_FROM),
    "kpi-conv": ("Revisar el argumentario: la conversión media no llega a", CONVERSION_GOOD_FROM),
    "kpi-absenteeism": ("Estudiar las ausencias: su tasa pasa de", ABSENCE_RATE_BAD_OVER),
    "kpi-avg-prod": ("Acompañar a la plantilla: la productividad media no llega a", PRODUCTIVITY_GOOD_FROM),
    "kpi-total-abs": ("Estudiar las ausencias: los días perdidos pasan de", ABSENCE_DAYS_BAD_OVER),
}


def detect_domain(columns: list[str]) -> str:
    """First domain one of whose words occurs in a column name."""
    lowered = [c.lower() for c in columns]
    for domain, words in DOMAIN_WORDS.items():
        if any(w in c for w in words for c in lowered):
            return domain
    return "general"


def detect_roles(columns: list[str], domain: str) -> dict[str, str]:
    roles = {}
    for role, words in ROLE_WORDS[domain].items():
        match = next((c for c in columns if any(w in c.lower() for w in words)), None)
        if match:
            roles[role] = match
    return roles


def direction(good: Column, if_good: str, otherwise: str) -> Column:
    return F.when(good, if_good).otherwise(otherwise)


def _tenth(x: Column) -> Column:
    return numbers.round_even(x, 1)


@dataclass
class KpiReport:
    domain: str
    roles: dict[str, str]
    kpis: DataFrame
    breakdown: DataFrame | None
    narrative: DataFrame
    recommendations: DataFrame


class _Domain:
    """Aggregates of a domain and the KPI rows made of them."""

    def __init__(self, df: DataFrame, roles: dict[str, str]):
        self.df = df
        self.roles = roles
        self.kinds = column_kinds(df)
        self.aggregates = [F.count(F.lit(1)).alias("rows")]
        self.entries: list[tuple[str, Column, Column, Column]] = []

    def number(self, role: str) -> Column:
        name = self.roles[role]
        c = F.col(f"`{name}`")
        if self.kinds[name] == TEXT:
            return numbers.finite(numbers.coerce_number(c))
        return numbers.finite(c.cast("double"))

    def add(self, kpi_id: str, value: Column, numeric: Column, trend: Column | None = None) -> None:
        none = F.lit(None).cast("string")
        self.entries.append((kpi_id, value, numeric.cast("double"), none if trend is None else trend))

    def aggregate(self, expression: Column, alias: str) -> Column:
        self.aggregates.append(expression.alias(alias))
        return F.col(alias)

    def distinct_or_rows(self, role: str, alias: str) -> Column:
        if role not in self.roles:
            return F.col("rows")
        return self.aggregate(F.count_distinct(F.col(f"`{self.roles[role]}`")), alias)

    def totals(self) -> DataFrame:
        return self.df.agg(*self.aggregates)

    def kpis(self) -> DataFrame:
        rows = []
        for kpi_id, value, numeric, trend in self.entries:
            title, subtitle, category = TITLES[kpi_id]
            rows.append(F.struct(
                F.lit(kpi_id).alias("kpi_id"), F.lit(title).alias("title"), value.alias("value"),
                numeric.alias("numeric_value"), trend.alias("change_direction"),
                F.lit(subtitle).alias("subtitle"), F.lit(category).alias("category"),
            ))
        return self.totals().select(F.inline(F.array(*rows)))

    def narrative(self) -> DataFrame:
        """One row: the KPIs in a sentence, each named by its own title."""
        parts = []
        for kpi_id, value, _, _ in self.entries:
            parts.append(F.concat(F.lit(f"{TITLES[kpi_id][0]}: "), F.coalesce(value, F.lit("N/A"))))
        return self.totals().select(
            F.concat(F.concat_ws("; ", *parts), F.lit(".")).alias("executive_summary")
        )


def _contact_center(d: _Domain) -> None:
    agents = d.distinct_or_rows("agent", "agents")
    d.add("kpi-agents", agents.cast("string"), agents)
    if "aht" in d.roles:
        aht = d.aggregate(F.avg(d.number("aht")), "aht")
        d.add("kpi-aht", F.concat(numbers.format_tenths(aht), F.lit(" seg")), _tenth(aht),
              direction(aht <= AHT_GOOD_UP_TO, "positive", "neutral"))
    if "quality" in d.roles:
        quality = d.aggregate(F.avg(d.number("quality")), "quality")
        d.add("kpi-quality", F.concat(numbers.format_tenths(quality), F.lit("%")), _tenth(quality),
              direction(quality >= QUALITY_GOOD_FROM, "positive", "negative"))
    if "conversion" in d.roles:
        conversion = d.aggregate(F.avg(d.number("conversion")), "conversion")
        d.add("kpi-conv", F.concat(numbers.format_tenths(conversion), F.lit("%")), _tenth(conversion),
              direction(conversion >= CONVERSION_GOOD_FROM, "positive", "neutral"))
    if "absence" in d.roles:
        c = F.col(f"`{d.roles['absence']}`").cast("string")
        absent = d.aggregate(F.count_if(text.is_yes(c)), "absent")
        rate = F.when(F.col("rows") > 0, _tenth(absent / F.col("rows") * 100)).otherwise(0.0)
        d.add("kpi-absenteeism", F.concat(numbers.float_text(rate), F.lit("%")), rate,
              direction(rate > ABSENCE_RATE_BAD_OVER, "negative", "positive"))


def _sales(d: _Domain) -> None:
    if "price" in d.roles:
        price = F.coalesce(d.number("price"), F.lit(0.0))
        quantity = F.coalesce(d.number("quantity"), F.lit(1.0)) if "quantity" in d.roles else F.lit(1.0)
        revenue = d.aggregate(F.sum(price * quantity), "revenue")
        ticket = d.aggregate(F.avg(price), "ticket")
        d.add("kpi-revenue", numbers.format_eur(revenue), revenue)
        d.add("kpi-ticket", numbers.format_eur(ticket), ticket)
    rows = F.col("rows")
    d.add("kpi-tx", F.concat(rows.cast("string"), F.lit(" pedidos")), rows)
    if "product" in d.roles:
        top = most_frequent(d.df, F.col(f"`{d.roles['product']}`").cast("string")).scalar()
        d.add("kpi-topprod", F.coalesce(top, F.lit("N/A")), F.lit(None))


def _people(d: _Domain) -> None:
    staff = d.distinct_or_rows("employee", "staff")
    d.add("kpi-emp-count", F.concat(staff.cast("string"), F.lit(" empleados")), staff)
    if "salary" in d.roles:
        salary = d.aggregate(F.avg(d.number("salary")), "salary")
        d.add("kpi-avg-salary", numbers.format_eur(salary), salary)
    if "productivity" in d.roles:
        done = d.aggregate(F.avg(d.number("productivity")), "productivity")
        d.add("kpi-avg-prod", F.concat(numbers.format_tenths(done), F.lit("%")), _tenth(done),
              direction(done >= PRODUCTIVITY_GOOD_FROM, "positive", "neutral"))
    if "absence" in d.roles:
        days = d.aggregate(F.coalesce(F.sum(d.number("absence")), F.lit(0.0)), "days")
        d.add("kpi-total-abs", F.concat(days.cast("bigint").cast("string"), F.lit(" días")), days,
              direction(days > ABSENCE_DAYS_BAD_OVER, "negative", "positive"))


def _general(d: _Domain) -> None:
    columns = len(d.df.columns)
    numeric = sum(1 for k in d.kinds.values() if k == NUMBER)
    d.add("kpi-gen-rows", F.format_number("rows", 0), F.col("rows"))
    d.add("kpi-gen-cols", F.lit(f"{columns} columnas"), F.lit(columns))
    d.subtitle = f"{numeric} numéricas, {columns - numeric} categóricas"


_BUILD = {
    "contact_center": _contact_center, "sales": _sales, "people_analytics": _people,
    "general": _general,
}


def kpi_report(
    df: DataFrame, domain: str | None = None, roles: dict[str, str] | None = None
) -> KpiReport:
    """KPIs of a clean table. ``domain`` and single ``roles`` can be given; names decide the rest."""
    domain = domain or detect_domain(df.columns)
    if domain not in ROLE_WORDS:
        raise ValueError(f"INVALID_PARAMETER: unknown domain '{domain}'")
    found = {**detect_roles(df.columns, domain), **(roles or {})}
    missing = [c for c in found.values() if c not in df.columns]
    if missing:
        raise ValueError(f"INVALID_COLUMN: {missing}")
    built = _Domain(df, found)
    _BUILD[domain](built)
    kpis = built.kpis()
    if domain == "general":
        subtitle = F.when(F.col("kpi_id") == "kpi-gen-cols", F.lit(built.subtitle))
        kpis = kpis.withColumn("subtitle", F.coalesce(subtitle, F.col("subtitle")))
    breakdown = category_breakdown(df, found["category"]) if "category" in found else None
    return KpiReport(domain, found, kpis, breakdown, built.narrative(), recommendations(kpis))


def recommendations(kpis: DataFrame) -> DataFrame:
    """(kpi_id, change_direction, recommendation): one row for each KPI that is not on its good side."""
    texts = {k: f"{text} {numbers_text(limit)}" for k, (text, limit) in ADVICE.items()}
    advice = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])
    missed = kpis.where(F.col("change_direction").isin("neutral", "negative") & F.col("numeric_value").isNotNull())
    text = F.concat(F.element_at(advice, F.col("kpi_id")), F.lit(" ("), "value", F.lit(")"))
    return missed.select("kpi_id", "change_direction", text.alias("recommendation"))


def numbers_text(limit: float) -> str:
    return f"{limit:g}"


def category_breakdown(df: DataFrame, column: str) -> DataFrame:
    """Rows and share per category, largest first; NULLs count in the total only.

    The total is summed from the counted categories, so the table is read once.
    """
    counted = df.groupBy(F.col(f"`{column}`").cast("string").alias("category_name")).agg(
        F.count(F.lit(1)).alias("count")
    )
    total = counted.agg(F.sum("count")).scalar()
    share = _tenth(F.col("count") / total * 100)
    return (
        counted.where(F.col("category_name").isNotNull())
        .select("category_name", "count", share.alias("percentage"))
        .orderBy(F.desc("count"), "category_name")
    )
