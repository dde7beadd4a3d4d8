"""Two versions of a table against a dictionary, and what the comparison shuffles."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import shuffled_rows
from tersa import compare_tables
from tersa.operators import compare

SCHEMA = "k int, part string, x double, n int, hash string, branch string, row int"


def brute(before, after):
    def sides(rows):
        out = {}
        for r in rows:
            out.setdefault(r[:2], []).append(r[2:])
        return out

    a, b, out = sides(before), sides(after), []
    for key in set(a) | set(b):
        one, two = a.get(key, []), b.get(key, [])
        if Counter(one) == Counter(two):
            continue
        status = "added" if not one else "removed" if not two else "changed"
        names = ["x", "n", "hash", "branch", "row"]
        changed = [c for i, c in enumerate(names) if status == "changed" and Counter(r[i] for r in one) != Counter(r[i] for r in two)]
        out.append((*key, status, changed, len(one), len(two)))
    return sorted(out, key=str)


def compared(spark, before, after):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in compare_tables(make(before), make(after), ["k", "part"]).collect()), key=str)


@pytest.mark.parametrize("branches", [2, 64, 4096])
def test_versions_against_a_dictionary(spark, monkeypatch, branches):
    monkeypatch.setattr(compare, "BRANCHES", branches)
    pick = random.Random(branches)
    row = lambda k: (k, pick.choice(("a", "b", None)), pick.choice((None, 0.5, 2.0)), pick.choice((1, None)), "h", None, k)
    before = [row(pick.choice((None, *range(150)))) for _ in range(300)]
    after = [r for r in before if pick.random() > 0.1] + [row(pick.choice((None, *range(200)))) for _ in range(30)]
    after = [(*r[:2], pick.choice((r[2], 7.0)) if pick.random() < 0.1 else r[2], *r[3:]) for r in after]
    assert compared(spark, before, after) == brute(before, after)


def test_equal_versions_and_empty_ones(spark):
    rows = [(1, "a", 0.5, 1, "h", "b", 2), (1, "a", 0.5, 1, "h", "b", 2), (None, None, None, None, None, None, None)]
    assert compared(spark, rows, list(reversed(rows))) == []
    assert compared(spark, rows, rows[1:]) == [(1, "a", "changed", ["x", "n", "hash", "branch", "row"], 2, 1)]
    assert compared(spark, [], rows) == brute([], rows) and compared(spark, rows, []) == brute(rows, [])
    assert compared(spark, [], []) == []


def test_values_that_are_only_paired_differently(spark):
    before = [(1, "a", 0.5, 1, None, None, None), (1, "a", 2.0, 2, None, None, None)]
    after = [(1, "a", 0.5, 2, None, None, None), (1, "a", 2.0, 1, None, None, None)]
    assert compared(spark, before, after) == [(1, "a", "changed", [], 2, 2)]


def test_wrong_keys_and_types(spark):
    df = spark.range(3).toDF("k")
    for keys in ([], ["nope"]):
        with pytest.raises(ValueError):
            compare_tables(df, df, keys)
    with pytest.raises(ValueError, match="another type"):
        compare_tables(df.withColumn("x", F.lit(1)), df.withColumn("x", F.lit("1")), ["k"])
    assert compare_tables(df, df.withColumn("more", F.lit(1)), ["k"]).count() == 0


def test_equal_parts_are_not_shuffled(spark, tmp_path):
    before, after = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(0, 300_000, 1, 4).selectExpr("id", "concat('name ', id) AS name").write.parquet(before)
    spark.range(0, 300_000, 1, 4).selectExpr("id", "concat('name ', IF(id = 777, 0, id)) AS name").where("id <> 5").write.parquet(after)

    def run():
        got = compare_tables(spark.read.parquet(before), spark.read.parquet(after), ["id"]).collect()
        assert sorted(tuple(r)[:3] for r in got) == [(5, "removed", []), (777, "changed", ["name"])]

    assert shuffled_rows(spark, run) < 2 * 4 * compare.BRANCHES + 5_000  # of 600 000 rows
