"""Word lists, tokens and patterns that decide what a cell or a column name means.

The lists are kept apart on purpose: the reader, the empty-row purge, the number parser, the
date parser and the type inference each have their own idea of what "missing" is.
"""

# --- fixed values: tokens that the CSV reader turns into NULL (exact text) ---------------------
READER_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- fixed values: a row made only of these (after strip, case sensitive) is an empty row ------
EMPTY_ROW_TOKENS = ["", "nan", "None", "null", "undefined"]

# --- fixed values: markers that stand for an absent number (lower case) ------------------------
MISSING_MARKERS = [
    "n/d", "n/a", "nd", "na", "-", "--", "---", "–", "—",
    "null", "none", "nan", "undefined", "", "n.a.", "n.d.", "s/n", "s/d", "nil", "n_a", "n_d",
]

# --- fixed values: date tokens (lower case) ----------------------------------------------------
DATE_SAMPLE_ERROR_TOKENS = ["invalid_date", "error", "n/d", "n/a", "--", "-"]
DATE_BLANK_TOKENS = ["nan", "none", "null", ""]
DATE_ERROR_TOKENS = ["invalid_date", "error", "n/d", "n/a", "nd", "na"]

# --- fixed values: yes/no words (lower case) ---------------------------------------------------
YES_TOKENS = ["si", "yes", "true", "1"]
BOOLEAN_TOKENS = ["true", "false", "si", "no", "s", "n", "1", "0", "yes", "y"]

# --- fixed values: words that stay upper case in title case ------------------------------------
ACRONYMS = [
    "SA", "S.A.", "SL", "S.L.", "SLU", "S.L.U.", "CIF", "NIF", "DNI", "IVA", "ID", "KPI", "SLA",
    "AHT", "CRM", "ERP", "USA", "UE", "IA", "AI",
]

# --- fixed values: labels written into results -------------------------------------------------
EMPTY_EVIDENCE = "[VALOR VACÍO]"
DEFAULT_FILL = "Desconocido"
HINT_MASKS = {"name": "[NOMBRE]", "email": "[EMAIL]", "phone": "[TELÉFONO]"}

# --- fixed values: patterns --------------------------------------------------------------------
CODE_TOKEN = r"[A-Za-z0-9]{2,6}[-_][A-Za-z0-9]{1,}"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(\+34[\s.-]?)?[6789]\d{2}[\s.-]?\d{3}[\s.-]?\d{3}"
EU_THOUSANDS = r"[+-]?\d{1,3}(\.\d{3})+(,\d+)?"
EU_DECIMAL = r"[+-]?\d*,\d+"
US_THOUSANDS = r"[+-]?\d{1,3}(,\d{3})+(\.\d+)?"
CURRENCY_SYMBOLS = ["€", "$", "USD", "EUR"]
DIRTY_NUMBER_SYMBOLS = ["€", "$", "%", "USD", "EUR"]
PLANNER_NUMBER_SYMBOLS = ["€", "$", "%", "usd", "eur"]

# --- fixed values: column-name tests (on the lower-cased name) ---------------------------------
PERCENT_SUFFIXES = ["_pct", "_percentage", "_porcentaje", "_rate", "_ratio", "_tasa", "_score"]
PERCENT_PREFIXES = ["pct_", "porcentaje_", "tasa_", "ratio_", "score_"]
PERCENT_NAMES = [
    "%", "pct", "porcentaje", "ctr", "cvr", "roi", "score", "score_calidad", "tasa_conversion",
    "conversion_rate", "churn_rate", "descuento_pct", "incidencias_pct",
]
CURRENCY_WORDS = [
    "precio", "importe", "coste", "salario", "sueldo", "monto", "price", "amount", "revenue",
]
DATE_WORDS = ["fecha", "date", "created", "updated", "ingreso", "alta", "baja"]
ID_PREFIXES = ["id", "cod"]
ID_SUFFIXES = ["_id", "_cod"]
ID_WORDS_QUALITY = ["codigo", "code", "cif", "dni", "nif", "sku", "ref", "pedido"]
ID_WORDS_PLAN = ["codigo", "code", "pedido", "cif", "dni", "nif", "sku", "ref", "referencia"]
ID_WORDS_PROFILE = [
    "codigo", "code", "cif", "dni", "nif", "sku", "ref", "referencia", "pedido", "factura",
    "ticket", "albaran",
]
PHONE_WORDS = ["telefono", "phone", "movil"]
NAME_WORDS = [
    "nombre", "name", "cliente", "empleado", "agente", "comercial", "contacto", "persona",
    "usuario",
]
LOCATION_WORDS = ["pais", "ciudad", "provincia", "region", "location", "country", "city"]
QUANTITY_WORDS = [
    "precio", "salario", "sueldo", "horas", "dias", "cantidad", "unidades", "llamadas", "aht",
    "segundos", "minutos", "importe", "monto", "descuento", "stock",
]
POSITIVE_WORDS = [
    "cantidad", "unidades", "llamadas", "conversiones", "leads", "clicks", "visitas", "ventas",
    "stock", "pedidos", "hours", "horas", "dias", "absentismo", "aht", "segundos", "minutos",
    "precio", "salario", "sueldo", "monto", "importe", "coste", "presupuesto",
]
QUANTITY_OR_DATE_WORDS = [
    "fecha", "date", "horas", "dias", "precio", "salario", "sueldo", "monto", "cantidad",
    "unidades", "llamadas", "aht", "segundos", "minutos", "stock", "descuento", "importe",
]
SAMPLED_NAME_WORDS = [
    "nombre", "cliente", "empleado", "agente", "comercial", "contacto", "usuario", "canal",
    "categoria", "departamento", "ciudad", "pais",
]
SAMPLED_QUANTITY_WORDS = [
    "precio", "salario", "sueldo", "horas", "dias", "cantidad", "unidades", "llamadas", "aht",
    "segundos", "minutos", "monto", "importe",
]
SAMPLED_PERCENT_WORDS = [
    "_pct", "pct", "productividad", "calidad", "conversion", "score", "tasa", "ratio",
]
SAMPLED_MARKERS = ["n/d", "n/a", "nd", "na", "-", "null", "none"]
