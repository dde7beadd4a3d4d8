"""Spelling clusters against all pairs, and how their neighbours are found."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tersa.operators import spelling
from tersa.operators.spelling import apply_proposals, mapping_steps, propose_mappings, spelling_key


def brute_key(v):
    v = v.lower().translate(str.maketrans(spelling.ACCENTED, spelling.PLAIN))
    v = "".join(" " if unicodedata.category(c)[0] in "ZPSC" else c for c in v)
    return " ".join(sorted(set(v.split())))


def one_edit(a, b):
    if a == b:
        return False
    edits = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    if b in edits or a in {b[:i] + b[i + 1 :] for i in range(len(b))}:
        return True
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1


def digits(k):
    return [run for run in "".join(c if c.isdigit() and c.isascii() else " " for c in k).split()], k[:1].isdigit(), k[-1:].isdigit()


def brute(values, ratio=4):
    counts, keys, labels = {}, {}, {}
    for v in values:
        if v is not None and brute_key(v):
            counts[v] = counts.get(v, 0) + 1
    for v, n in counts.items():
        k = brute_key(v)
        keys[k] = keys.get(k, 0) + n
        labels.setdefault(k, {})
        labels[k][v.strip()] = labels[k].get(v.strip(), 0) + n
    parent = {}
    for a in keys:
        near = [(keys[b], b) for b in keys if one_edit(a, b) and keys[b] >= ratio * keys[a] and digits(a) == digits(b)
                and 5 <= len(a) <= 64 and 5 <= len(b) <= 64]
        if near:
            parent[a] = max(near)[1]
    out = []
    for v, n in counts.items():
        root = k = brute_key(v)
        while root in parent:
            root = parent[root]
        label = min((-m, x) for x, m in labels[root].items())[1]
        if v != label:
            out.append(("v", v, label, n, keys[root], "spelling" if k == root else "typo"))
    return sorted(out)


def proposed(spark, values, **how):
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(3)
    return sorted(tuple(r) for r in propose_mappings(df, **how).collect())


def test_random_typos_against_all_pairs(spark):
    pick = random.Random(5)
    words = ["barcelona", "madrid norte", "sevilla", "san sebastian 2", "san sebastian 3", "bilbao", "oviedo", "lugo", "valencia"]
    values = []
    for _ in range(1500):
        w = pick.choice(words[: 1 + pick.randrange(len(words))])
        for _ in range(pick.choice((0, 0, 0, 0, 1, 1, 2))):
            i = pick.randrange(len(w) - 1)
            w = pick.choice((w[:i] + w[i + 1 :], w[:i] + pick.choice("aeiou1") + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + pick.choice("xyz") + w[i + 1 :]))
        values.append(pick.choice((w, w, w.upper(), " " + w, w.title(), w.replace("a", "á"), " ".join(reversed(w.split())))))
    assert proposed(spark, values) == brute(values)


def test_awkward_values(spark):
    values = [None, "", "  ", "--", "a", "A", "é", "E", "word word", "Word", "漢字", "x" * 70, "x" * 69 + "y", "one,two", "two one", "two one"]
    values += ["label"] * 16 + ["labek"] * 4 + ["lakek"] + ["\tlabel "] * 3 + ["Straße", "strasse", "12345"] + ["12346"] * 9
    assert proposed(spark, values) == brute(values)
    assert proposed(spark, []) == [] and proposed(spark, [None]) == []
    assert ("v", "lakek", "label", 1, 19, "typo") in proposed(spark, values)  # over labek, which is a typo itself
    with pytest.raises(ValueError):
        propose_mappings(spark.range(3))
    with pytest.raises(ValueError):
        propose_mappings(spark.createDataFrame([("a",)], "v string"), ratio=1)


def test_a_large_block_yields_a_link_for_each_member_not_pairs(spark):
    """A thousand keys that differ in one place only: the leader stands for all."""
    letters = [chr(0x4E00 + i) for i in range(1000)]
    values = [f"abc{x}def" for x in letters] + ["abcZdef"] * 50
    df = spark.createDataFrame([(v,) for v in values], "v string")
    nodes = df.groupBy(F.lit("v").alias("column_name"), spelling_key("v").alias("key")).agg(F.count("*").alias("n"))
    links = spelling._neighbours(nodes, 4)
    assert links.count() == 1000 and {r.parent for r in links.collect()} == {"abczdef"}
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_steps_and_joins_give_the_same_table(spark):
    rows = [(i, v, v) for i, v in enumerate(["Madrid"] * 8 + ["madrid", " Madrid", "Madird", None, "Lugo", "LUGO", "Lugo"])]
    df = spark.createDataFrame(rows, "id int, v string, w string").drop("w")
    found = propose_mappings(df)
    (step,) = mapping_steps(found)
    assert step.operation == "normalize_category" and step.parameters["mappings"] == {" Madrid": "Madrid", "LUGO": "Lugo", "Madird": "Madrid", "madrid": "Madrid"}
    got = [r.v for r in apply_proposals(df, found).orderBy("id").collect()]
    assert got == ["Madrid"] * 11 + [None] + ["Lugo"] * 3
    with pytest.raises(ValueError, match="TOO_MANY_VALUES"):
        mapping_steps(found, most=2)
