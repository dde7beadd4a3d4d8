"""The catalog operations one by one, and their parameter checks."""

import statistics

import pytest
from pyspark.sql import functions as F

from tersa import (
    Step, apply_operation, execute_plan, list_operations, profile, propose_steps, quality_issues,
    quality_overall, register_operation,
)
from tersa.operators.catalog import remove_duplicates, unregister_operation
from conftest import shuffled_rows
from tersa.operators import selection
from tersa.operators.selection import (
    _with_order, bracketed, column_median, exact_medians, frequent_values, grouped_medians, most_frequent, splitters,
)


@pytest.fixture
def run(texts):
    def apply(values, operation, **params):
        out = apply_operation(texts(values), operation, "v", **params)
        return [r.v for r in out.orderBy("i").collect()]

    return apply


def test_closed_list():
    assert list(list_operations()) == [
        "trim_text", "normalize_case", "normalize_category", "convert_datetime", "convert_numeric",
        "round_numeric", "clamp_range", "fill_missing", "remove_duplicates", "rename_column",
        "drop_column",
    ]


def test_text_operations(run):
    assert run([" a  b ", None, "c"], "trim_text") == ["a b", None, "c"]
    assert run(["ANA sa", None], "normalize_case") == ["Ana SA", None]
    assert run(["Ana", None], "normalize_case", mode="upper") == ["ANA", None]
    assert run(["Ana", None], "normalize_case", mode="lower") == ["ana", None]
    assert run(["web", "WEB", None], "normalize_category", mappings={"web": "Web", "x": "y"}) == ["Web", "WEB", None]


def test_large_category_mapping(run):
    mappings = {f"k{i}": f"v{i}" for i in range(200)}
    assert run(["k7", "k199", "other", None], "normalize_category", mappings=mappings) == ["v7", "v199", "other", None]


def test_dates(run):
    values = ["2026-01-05", "06/01/2026", "invalid_date", " ", None]
    assert run(values, "convert_datetime") == ["2026-01-05", "2026-01-06", None, None, None]
    assert run(values[:2], "convert_datetime", target_format="%d.%m.%Y") == ["05.01.2026", "06.01.2026"]


def test_numbers(run, spark):
    assert run(["1.200,50 €", "N/D", "$1,234.56"], "convert_numeric") == [1200.5, None, 1234.56]
    assert run(["2.346", "x", "-0.125"], "round_numeric") == [2.35, None, -0.12]
    assert run(["-5", "7", "1e3", "x", None], "clamp_range", min_value=0, max_value=100.0) == [0.0, 7.0, 100.0, None, None]
    typed = spark.createDataFrame([(1.125,), (float("nan"),), (None,)], "v double")
    assert [r.v for r in apply_operation(typed, "convert_numeric", "v").collect()] == [1.125, None, None]


def test_fill_missing(run, spark):
    assert run(["a", " ", None], "fill_missing") == ["a", "Desconocido", "Desconocido"]
    assert run(["b", "a", "b", "a", None], "fill_missing", strategy="mode") == ["b", "a", "b", "a", "a"]
    assert run([None, " "], "fill_missing", strategy="mode", value="x") == ["x", "x"]
    typed = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 10.0), (3, None)], "i int, x double")
    for strategy, value in (("mean", 13 / 3), ("median", 2.0), ("constant", 7.0)):
        out = apply_operation(typed, "fill_missing", "x", strategy=strategy, value=7)
        assert out.where("i = 3").first().x == pytest.approx(value)
    assert run(["1", "4", None], "fill_missing", strategy="mean") == ["1", "4", "2.5"]


def test_remove_duplicates(spark):
    rows = [(1, "a", None), (2, "a", None), (3, "b", 1), (3, "b", 1)]
    df = spark.createDataFrame(rows, "i int, k string, x int")
    assert apply_operation(df, "remove_duplicates").count() == 3
    first = apply_operation(df, "remove_duplicates", order_by="i", subset_columns=["k", "x"])
    assert sorted(tuple(r) for r in first.collect()) == [(1, "a", None), (3, "b", 1)]


def test_key_dedup_does_not_depend_on_partitions_and_limits_before_the_shuffle(spark):
    df = spark.range(5000).selectExpr("id AS i", "CASE WHEN id % 3 < 2 THEN 0 ELSE id % 50 END AS k", "id % 7 AS x")
    results = []
    for n in (1, 16):
        out = remove_duplicates(df.repartition(n), ["k"], "i")
        results.append(sorted(tuple(r) for r in out.collect()))
    assert results[0] == results[1]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_rename_and_drop(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert apply_operation(df, "rename_column", "a", new_name="c").columns == ["c", "b"]
    assert apply_operation(df, "drop_column", "a").columns == ["b"]


@pytest.mark.parametrize("operation, column, params, code", [
    ("trim_text", "nope", {}, "INVALID_COLUMN"),
    ("trim_text", None, {}, "INVALID_COLUMN"),
    ("normalize_case", "v", {"mode": "camel"}, "INVALID_PARAMETER"),
    ("normalize_category", "v", {"mappings": {}}, "INVALID_PARAMETER"),
    ("normalize_category", "v", {}, "INVALID_PARAMETER"),
    ("convert_datetime", "v", {"target_format": "%Q"}, "INVALID_PARAMETER"),
    ("round_numeric", "v", {"decimals": -1}, "INVALID_PARAMETER"),
    ("round_numeric", "v", {"decimals": "2"}, "INVALID_PARAMETER"),
    ("fill_missing", "v", {"strategy": "magic"}, "INVALID_PARAMETER"),
    ("fill_missing", "i", {"value": "Desconocido"}, "INVALID_PARAMETER"),
    ("remove_duplicates", None, {"subset_columns": ["nope"]}, "INVALID_COLUMN"),
    ("rename_column", "v", {}, "INVALID_PARAMETER"),
    ("rename_column", "v", {"new_name": "i"}, "INVALID_PARAMETER"),
    ("run_script", "v", {}, "UNREGISTERED_OPERATION"),
])
def test_parameter_checks(texts, operation, column, params, code):
    with pytest.raises(ValueError, match=code):
        apply_operation(texts(["a"]), operation, column, **params)


def test_every_row_operation_accepts_every_column_type(spark):
    df = spark.sql(
        "SELECT 1 AS n, 2.5D AS x, DATE'2026-01-05' AS d, TIMESTAMP'2026-01-05 10:00:00' AS t, true AS b, "
        "CAST(1.5 AS DECIMAL(10,2)) AS m, 'a' AS s UNION ALL SELECT NULL, double('nan'), NULL, NULL, NULL, NULL, NULL"
    )
    operations = [
        ("trim_text", {}), ("normalize_case", {}), ("normalize_category", {"mappings": {"1": "uno", "true": "si"}}),
        ("convert_datetime", {}), ("convert_numeric", {}), ("round_numeric", {}),
        ("clamp_range", {"min_value": 0, "max_value": 2}), ("fill_missing", {"value": 7}),
        ("fill_missing", {"strategy": "mode"}),
    ]
    for operation, params in operations:
        steps = [Step(operation, c, params) for c in df.columns]
        done = execute_plan(df, steps)
        assert not done.errors and done.frame.count() == 2
        assert [r.status for r in done.audit.collect()] == ["applied"] * len(steps)
        one = apply_operation(df, operation, "d", **params)
        assert one.count() == 2
    filled = apply_operation(df, "fill_missing", "x", value=7)
    assert sorted(r.x for r in filled.collect()) == [2.5, 7.0]
    assert apply_operation(df, "convert_datetime", "d").first().d == "2026-01-05"
    labels = apply_operation(df, "normalize_category", "b", mappings={"true": "si"})
    assert labels.first().b == "si"


def test_odd_column_names_and_empty_tables(spark):
    df = spark.createDataFrame([(" 1,5 € ", "x"), ("N/D", " y")], "`Precio (€) v1.0` string, `a b` string")
    steps = propose_steps(df)
    assert ("Precio (€) v1.0", "convert_numeric") in {(s.column, s.operation) for s in steps}
    clean = execute_plan(df, steps).frame
    assert {r[0] for r in clean.collect()} == {1.5, None} or {r[0] for r in clean.collect()} == {1.5}
    assert quality_issues(df).count() > 0
    empty = df.limit(0)
    assert profile(empty).count() == 0 and propose_steps(empty) == []
    assert quality_overall(empty).first().overall_score == 100.0


def test_users_can_add_column_functions(run):
    register_operation("reverse_text", F.reverse, "Reverse")
    try:
        assert run(["abc", None], "reverse_text") == ["cba", None]
        with pytest.raises(ValueError):
            register_operation("trim_text", F.reverse)
    finally:
        unregister_operation("reverse_text")


@pytest.mark.parametrize("values", [
    [1.0], [2.0, 1.0], [5.0, 1.0, 3.0], [1e-12, -1e-12, 1e300, -1e300], [7.0] * 9 + [8.0] * 9,
    [float(i * i % 97) - 40 for i in range(500)], [0.1 * i for i in range(401)] + [1e15],
    [5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 0.0], [1.7976931348623157e308, -1.7976931348623157e308, -0.0],
])
def test_exact_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(3)
    assert column_median(df, F.col("x")).first()[0] == statistics.median(values)


@pytest.mark.parametrize("values", [
    "1 + id * 1e-12", "CAST(id % 3 AS DOUBLE)", "pow(10.0D, id % 300 - 150)", "IF(id < 700000, 5.0D, rand(1))", "-id * 1e300 / 1e6",
])
def test_medians_of_a_million_values_by_pivots(spark, values):
    """Two splitters leave a few values in ten thousand, however a million are spread, and no part of them is large."""
    df = spark.range(1_000_000).selectExpr("CAST(id % 2 AS INT) AS k", f"{values} AS v")
    exact = df.groupBy("k").agg(F.percentile("v", 0.5).alias("median"))
    assert sorted(map(tuple, grouped_medians(df).collect())) == sorted(map(tuple, exact.collect()))
    kept = bracketed(df, splitters(df, "k"), "k").where("v IS NOT NULL").groupBy("part").count()
    most = kept.agg(F.max("count"), F.sum("count")).first()
    assert most[1] <= 2 * 500_000 * 10 / selection.SKETCH_ACCURACY and most[0] <= 500


def test_a_bracket_that_misses_is_an_error(spark, monkeypatch):
    df = spark.range(1000).selectExpr("0 AS k", "CAST(id AS DOUBLE) AS v")
    wrong = spark.sql("SELECT 0 AS k, 1000L AS total, 700.0D AS low, 800.0D AS high")
    monkeypatch.setattr(selection, "splitters", lambda numbers, key: wrong)
    with pytest.raises(Exception, match="INEXACT_SKETCH"):
        grouped_medians(df).collect()


def test_medians_of_groups_read_their_source_twice(spark, tmp_path):
    spark.range(5000).selectExpr("id % 4 AS k", "rand(5) AS v").write.parquet(str(tmp_path / "t"))
    medians = grouped_medians(spark.read.parquet(str(tmp_path / "t")))
    medians.collect()
    plan = medians._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 2


def test_weighted_medians_by_key(spark):
    rows = [("a", 1.0, 3), ("a", 2.0, 1), ("a", -5.0, 1), ("a", None, 9), ("b", 7.0, 2), ("b", 8.0, 2)]
    df = spark.createDataFrame(rows, "k string, v double, w bigint")
    limits = df.where("v IS NOT NULL").groupBy("k").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("w").alias("total")
    )
    assert {r.k: r.median for r in exact_medians(df, limits, "k").collect()} == {"a": 1.0, "b": 7.5}


@pytest.mark.parametrize("few", [0, 1 << 40])
def test_most_frequent(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "GROUP_BYTES", few)
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "v string")
    assert most_frequent(df, F.col("v")).first()[0] == "a"
    assert most_frequent(df.limit(0), F.col("v")).first()[0] is None


def _brute_top(rows, k):
    from collections import Counter

    counts = Counter((key, v) for key, v in rows if v is not None)
    out = []
    for key in {key for key, _ in counts}:
        best = sorted((-n, v) for (x, v), n in counts.items() if x == key)[:k]
        out += [(key, v, -n, i + 1) for i, (n, v) in enumerate(best)]
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [1, 3, 40])
def test_frequent_values_are_exact_with_ties(spark, monkeypatch, k):
    monkeypatch.setattr(selection, "BUCKETS", 64)
    monkeypatch.setattr(selection, "SPARE_BUCKETS", 2)
    rows = [(1, f"v{i % 9}") for i in range(60)] + [(2, f"w{i}") for i in range(300)]  # ties of a few, ties of all
    rows += [(3, f"z{i * i % 251}") for i in range(900)] + [(3, "hot")] * 500 + [(4, None)] * 5 + [(5, "one")]
    df = spark.createDataFrame(rows, "k int, v string").repartition(5)
    for group_bytes in (0, 1 << 40):
        assert sorted((tuple(r) for r in frequent_values(df, k, group_bytes=group_bytes).collect()), key=str) == _brute_top(rows, k)
        assert frequent_values(df.limit(0), k, group_bytes=group_bytes).count() == 0


def test_a_clear_winner_shuffles_no_values(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 400_000, 1, 4).selectExpr("IF(id % 10 = 0, 'hot', concat('v', id)) AS v").write.parquet(path)
    df = spark.read.parquet(path)

    cells = df.select(F.lit(0).alias("k"), "v")

    def clear():
        assert [r.v for r in frequent_values(cells, 1, group_bytes=0).collect()] == ["hot"]

    files = df.rdd.getNumPartitions()
    assert shuffled_rows(spark, clear) < 2 * files * selection.BUCKETS + 20_000  # of 360 000 different values


def test_numbers_order_as_their_64_bits(spark):
    """One number for each double, in the same order, so no pass of a median meets a crowded cell."""
    import random
    import struct

    rng = random.Random(4)
    values = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(3000)]
    values += [s * 2.0**e * f for e in range(-1022, 1023, 7) for s in (1, -1) for f in (1, 1 + 2**-52, 2 - 2**-52)]
    values += [rng.random() * 1e-9 for _ in range(500)] + [0.0, 5e-324, -5e-324, 1e-310, 1e6]
    values = sorted({v for v in values if abs(v) < float("inf")})
    df = _with_order(spark.createDataFrame([(v,) for v in values], "v double"))
    orders = [r.order for r in df.orderBy("v").collect()]
    assert all(a < b for a, b in zip(orders, orders[1:]))
    near = _with_order(spark.range(200_000).selectExpr("rand(3) * 1e-6 AS v")).selectExpr("shiftright(order, 16) AS cell")
    assert near.groupBy("cell").count().agg(F.max("count")).first()[0] <= 65_536
