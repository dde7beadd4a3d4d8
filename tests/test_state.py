"""Profiles of parts: what merges exactly, what is estimated and how well, and the stored table."""

import pytest
from pyspark.sql import functions as F

from tersa import ProfileStore, merge_states, profile, profile_of_states, profile_state

EXACT = ["position", "column_name", "inferred_type", "semantic_hint", "null_count", "null_percentage", "min_value", "max_value", "mean", "std"]


def days(spark):
    rows = spark.range(3000).selectExpr(
        "id", "id % 3 AS day", "IF(id % 11 = 0, NULL, 1e9 + id % 97) AS amount", "concat(IF(id % 2 = 0, ' ', ''), 'v', id % 40) AS word",
        "IF(id % 5 = 0, 'N/D', concat(id % 700, ',5 €')) AS price", "IF(id % 4 = 0, '05/01/2026', '2026-01-05') AS when_",
        "date_add(date'2026-01-01', CAST(id % 60 AS INT)) AS on_day", "CAST(NULL AS STRING) AS nothing", "CAST(id AS DECIMAL(20,2)) AS exact",
    )
    return rows.drop("day"), [rows.where(F.col("day") == i).drop("day") for i in range(3)]


def rows_of(df, columns=EXACT):
    return [tuple(r) for r in df.select(columns).orderBy("position").collect()]


def test_parts_add_up_to_the_profile_of_the_whole(spark):
    whole, parts = days(spark)
    states = [profile_state(p, f"day {i}", "id") for i, p in enumerate(parts)]
    merged = profile_of_states(states[0].unionByName(states[1]).unionByName(states[2]))
    exact = profile(whole, order_by="id")
    assert rows_of(merged) == rows_of(exact) == rows_of(profile(whole, order_by="id", approx=True))
    for m, e in zip(merged.orderBy("position").collect(), exact.orderBy("position").collect()):
        assert abs(m.unique_count - e.unique_count) <= 0.03 * e.unique_count
        assert m.estimated and m.sample_values[:1] != [] or e.sample_values == []
        if e.median is not None:
            assert abs(m.median - e.median) <= 0.02 * max(1, e.max_value - e.min_value)


def test_merging_in_steps_is_merging_at_once(spark):
    _, parts = days(spark)
    a, b, c = [profile_state(p, f"day {i}", "id") for i, p in enumerate(parts)]
    steps = merge_states(merge_states(a.unionByName(b), "day 0").unionByName(c), "all")
    once = merge_states(a.unionByName(b).unionByName(c), "all")
    columns = [x for x in once.columns if not x.endswith("sketch") and x not in ("mean", "squares", "number_sum")]
    assert rows_of(steps, columns) == rows_of(once, columns)
    for x, y in zip(steps.orderBy("position").collect(), once.orderBy("position").collect()):
        if y.mean is not None:
            assert x.mean == pytest.approx(y.mean, rel=1e-12) and x.squares == pytest.approx(y.squares, rel=1e-9)


def test_first_values_come_from_the_first_part_that_has_some(spark):
    make = lambda values: spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    a, b = make(["x", None, "x", "y"]), make(["z", "y", "w", "q", "p"])
    states = profile_state(a, "2026-01-02", "i").unionByName(profile_state(b, "2026-01-01", "i"))
    got = {r.column_name: r.sample_values for r in profile_of_states(states).collect()}
    assert got["v"] == ["z", "y", "w", "q", "p"]
    states = profile_state(make([None]), "a", "i").unionByName(profile_state(make(["y", "x"]), "b", "i"))
    assert {r.column_name: r.sample_values for r in profile_of_states(states).collect()}["v"] == ["y", "x"]


def test_a_store_reads_only_what_is_added(spark, tmp_path):
    whole, parts = days(spark)
    store = ProfileStore(spark, str(tmp_path / "store"))
    store.add(parts[0], "day 0", "id")
    store.add(parts[0].limit(7), "day 1", "id")
    store.add(parts[1], "day 1", "id")  # a part that is there is replaced
    store.add(parts[2].where("false"), "day 2")
    assert sorted(map(tuple, store.parts().collect())) == [("day 0", 1000), ("day 1", 1000), ("day 2", 0)]
    assert rows_of(store.profile()) == rows_of(profile(parts[0].unionByName(parts[1]), order_by="id"))
    store.add(parts[2], "day 2", "id")
    assert rows_of(store.profile()) == rows_of(profile(whole, order_by="id"))
    store.add(parts[2].where("false"), "day 2")  # a day that was emptied
    assert rows_of(store.profile()) == rows_of(profile(parts[0].unionByName(parts[1]), order_by="id"))
    with pytest.raises(ValueError):
        store.add(whole, "")


def test_parts_with_other_columns_are_an_error(spark):
    a = profile_state(spark.range(3).toDF("x"), "a")
    for other in (spark.range(3).toDF("y"), spark.createDataFrame([("1",)], "x string")):
        with pytest.raises(Exception, match="INCOMPATIBLE_PARTS"):
            profile_of_states(a.unionByName(profile_state(other, "b"))).collect()


def test_states_stay_small_and_no_value_is_shuffled(spark):
    state = profile_state(spark.range(200_000).selectExpr("id", "concat('name ', id) AS name"), "p")
    size = state.select(F.sum(F.length("distinct_sketch") + F.length("number_sketch"))).first()[0]
    assert size < 100_000
    estimate = {r.column_name: r.unique_count for r in profile_of_states(state).collect()}
    assert all(abs(n - 200_000) < 0.03 * 200_000 for n in estimate.values())
