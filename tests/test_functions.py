"""Scalar vectors: numbers, dates, text and masks."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tersa.functions import dates, masks, numbers, text


def test_number_vectors(apply):
    vectors = {
        "1.234.567,89 €": 1234567.89, "1.200,50 €": 1200.5, "2.500,00": 2500.0, "350,75": 350.75,
        "$1,234.56": 1234.56, "$350.00": 350.0, "14.1%": 14.1, "15.5%": 15.5, "-3": -3.0,
        "450": 450.0, "1.250,00 €": 1250.0, "$890.50": 890.5, " 12 ": 12.0,
        "1,234": 1.234, "0.500": 500.0, "1.125": 1125.0, "1_000": 1000.0, ".5": 0.5, "5.": 5.0,
        "100 USD": None, "1d": None, "0x1p3": None, "inf": None, "1e999": None,
        "Laptop Pro 15": None, "N/D": None, "N/A": None, "": None, None: None,
    }
    assert apply(numbers.parse_number, list(vectors)) == list(vectors.values())


def test_currency_words_can_be_dropped_everywhere(apply):
    assert apply(lambda c: numbers.parse_number(c, False), ["100 USD", "EUR 7,5"]) == [100.0, 7.5]


def test_missing_markers(apply):
    markers = ["--", "---", "-", "–", "—", "N/D", "n/d", "N/A", "n/a", "null", "none", "nan", "  --  ", "s/n", "_-_"]
    assert all(apply(numbers.is_missing_marker, markers))
    assert apply(numbers.parse_number, markers) == [None] * len(markers)
    assert not any(apply(numbers.is_missing_marker, ["0", "a-b", "x"]))


def test_strict_numbers_and_rounding(spark, apply):
    assert apply(numbers.coerce_number, [" 45 ", "1,5", "1e2", "1_0", "$4", "1d"]) == [45.0, None, 100.0, None, None, None]
    df = spark.createDataFrame([(2.5, 0), (0.125, 2), (1.005, 2), (-2.5, 0)], "x double, d int")
    from pyspark.sql import functions as F
    assert [r[0] for r in df.select(numbers.round_even(F.col("x"), 0)).collect()] == [2.0, 0.0, 1.0, -2.0]
    assert [r[0] for r in df.select(numbers.round_even(F.col("x"), 2)).collect()] == [2.5, 0.12, 1.0, -2.5]


def test_number_text(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1e7,), (12345678.5,), (2.5,), (0.00025,), (1234567.891,)], "x double")
    got = [r[0] for r in df.select(numbers.float_text(F.col("x"))).collect()]
    assert got == ["10000000.0", "12345678.5", "2.5", "0.00025", "1234567.891"]
    assert df.select(numbers.format_eur(F.col("x"))).collect()[4][0] == "1.234.567,89 €"


def test_date_vectors(apply):
    vectors = {
        "2026-01-05": dt.date(2026, 1, 5), "2026/1/5": dt.date(2026, 1, 5),
        "06/01/2026": dt.date(2026, 1, 6), "07-01-2026": dt.date(2026, 1, 7),
        "01/13/2026": dt.date(2026, 1, 13), "2026-01-05 10:00": dt.date(2026, 1, 5),
        "13/01/2026 10:30": dt.date(2026, 1, 13), "20260105": dt.date(2026, 1, 5),
        "5 Jan 2026": dt.date(2026, 1, 5), "January 5, 2026": dt.date(2026, 1, 5),
        "2026.01.05": dt.date(2026, 1, 5), "05.01.2026": dt.date(2026, 5, 1),
        "1/2/26": dt.date(2026, 1, 2), "2026-01": dt.date(2026, 1, 1),
        "2026": dt.date(2026, 1, 1), "Jan 2026": dt.date(2026, 1, 1), "September 2026": dt.date(2026, 9, 1),
        "20260105 10:00": dt.date(2026, 1, 5), "2026-01-05T10": dt.date(2026, 1, 5), "5-MAR-2026": dt.date(2026, 3, 5),
        "12 Decorations 2026": None, "10 Marbles 2026": None, "Marbles 10, 2026": None, "9999-12-31": None, "0850": None,
        "31/02/2026": None, "2026-13-05": None, "2026-01-05xyz": None, "2026-01-05 25:00": None,
        "31/12/1600": None, "hello": None, "85": None, "invalid_date": None, "": None, None: None,
    }
    assert apply(dates.parse_date, list(vectors)) == list(vectors.values())
    bad = apply(lambda c: dates.is_invalid_date(c, dates.parse_date(c)), ["invalid_date", "N/D", " nan ", "", None, "2026-01-05"])
    assert bad == [True, True, False, False, False, False]


def test_strftime_formats(apply):
    out = apply(lambda c: dates.strftime(dates.parse_timestamp(c), "%d/%m/%y %H:%M día"), ["2026-01-05 10:07"])
    assert out == ["05/01/26 10:07 día"]
    with pytest.raises(ValueError, match="INVALID_PARAMETER"):
        dates.java_pattern("%Q")


def test_title_case(apply):
    vectors = {
        "TALLERES ROBLES SLU": "Talleres Robles SLU", "marín s.l.u.": "Marín S.L.U.",
        "PED-201": "PED-201", "SOPORTE RRHH SL": "Soporte Rrhh SL", " juan PÉREZ ": "Juan Pérez",
        "a  b": "A  B", "x\tsa y": "X\tsa Y", "": "", None: None, "ped-7 sa": "PED-7 SA",
    }
    assert apply(text.smart_title, list(vectors)) == list(vectors.values())


def test_whitespace_is_unicode_aware(apply):
    values = [" a b　", "a", " a", "a  b", "\ta\n"]
    assert apply(text.collapse_spaces, values) == ["a b", "a", "a", "a b", "a"]
    assert apply(text.has_excess_whitespace, values) == [True, False, True, True, True]
    assert apply(text.is_blank, ["", "  \t", "x", None]) == [True, True, False, None]


def test_all_caps(apply):
    values = ["RRHH", "AB", "Abc", "123", "A1-2", "ÁÉÍ", "STRAßE", "CALLE Nº 5", " SA ", "ABC DEF"]
    assert apply(text.is_all_caps, values) == [s.strip().isupper() and len(s.strip()) > 2 for s in values]


def test_masks(apply):
    assert apply(lambda c: masks.mask_value(c, "name"), [" Juan Pérez ", "", None]) == ["[NOMBRE]", "", None]
    assert apply(lambda c: masks.mask_value(c, "email"), ["maria@corp.es"]) == ["[EMAIL]"]
    assert apply(lambda c: masks.mask_value(c, "phone"), ["600123456", "+34 911 234 567"]) == ["[TELÉFONO]"] * 2
    free = ["Contactar en juan@empresa.com", "Sin novedad", "699876543", "tel 699876543"]
    assert apply(masks.mask_value, free) == ["Contactar en [EMAIL]", "Sin novedad", "[TELÉFONO]", "tel 699876543"]
    assert apply(lambda c: masks.mask_value(c, "unknown", True), free[-1:]) == ["tel [TELÉFONO]"]


words = st.lists(
    st.text(alphabet="abzÁñSAL.-_19 \t €$%,", max_size=14), min_size=1, max_size=25
)
relaxed = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@relaxed
@given(words)
def test_cleaning_is_idempotent(apply, values):
    once = apply(text.collapse_spaces, values)
    assert apply(text.collapse_spaces, once) == once
    title = apply(text.smart_title, values)
    assert apply(text.smart_title, title) == title


@relaxed
@given(words)
def test_title_case_fast_path_equals_token_path(apply, values):
    acronyms = set(__import__("tersa.functions.vocabulary", fromlist=["x"]).ACRONYMS)
    import re

    def slow(s):
        out = []
        for w in s.strip().split(" "):
            w = w.strip()
            keep = w.upper() in acronyms or re.match(r"^[A-Za-z0-9]{2,6}[-_][A-Za-z0-9]{1,}$", w)
            out.append(w.upper() if keep else w.capitalize())
        return " ".join(out) if s.strip() else ""

    assert apply(text.smart_title, values) == [slow(s) for s in values]


@relaxed
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=20))
def test_clamp_stays_in_range(spark, values):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = [r[0] for r in df.select(numbers.clamp(F.col("x"), -1, 5)).collect()]
    assert got == [min(max(v, -1.0), 5.0) for v in values]


def test_any_year_is_an_option(apply):
    read = lambda c: dates.parse_date(c, any_year=True)
    assert apply(read, ["9999-12-31", "31/12/1600", "2026"]) == [
        dt.date(9999, 12, 31), dt.date(1600, 12, 31), dt.date(2026, 1, 1)
    ]


def test_hours_are_read(apply):
    read = lambda c: dates.strftime(dates.parse_timestamp(c), "%Y-%m-%d %H:%M")
    values = ["2026-01-05T10", "2026-01-05 07", "20260105 10:07", "05/01/2026 23"]
    assert apply(read, values) == ["2026-01-05 10:00", "2026-01-05 07:00", "2026-01-05 10:07", "2026-01-05 23:00"]


def test_long_texts_take_time_in_proportion(apply):
    n = 100_000
    values = ["1" + "_1" * n, "1" * n + "x", "1" * n, "_" + "1_" * n, " " * n + "7", "1." + "0" * n + "e"]
    assert apply(numbers.parse_number, values) == [None, None, None, None, 7.0, None]
    assert apply(numbers.coerce_number, values)[1] is None
    assert apply(lambda c: c.rlike(numbers.PLAIN_FLOAT), values) == [False, False, True, False, True, False]


def test_number_separators_still_read(apply):
    assert apply(numbers.parse_number, ["1_000", "1__0", "_1", "1_", "12.", ".5", "1_0.2_5e1_0", "1e5", "+3", "-0.5"]) == [
        1000.0, None, None, None, 12.0, 0.5, 10.25e10, 1e5, 3.0, -0.5
    ]
