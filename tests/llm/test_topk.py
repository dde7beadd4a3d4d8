import math
import random

import numpy as np
import pytest

from tersa.llm import topk
from tersa.llm.common import Scratch

SCHEMA = "vec_id bigint, embedding array<float>, rank string, block string, score string"


def brute(rows, k, every):
    usable = [
        (i, [math.floor(256 * x) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, (i, q) in enumerate(usable):
        if i % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(usable) if b != a)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


def run(spark, rows, k=5, every=50):
    df = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], SCHEMA).repartition(3)
    out = topk.top_k(df, Scratch(spark, "t"), k, every)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect())


def as_float(v):
    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


@pytest.mark.parametrize("block,queries", [(4096, 16384), (64, 4)])
def test_against_brute_force(spark, block, queries, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES_AT_ONCE", queries)
    rng = random.Random(5)
    rows = [(i, as_float([rng.gauss(0, 1) for _ in range(8)])) for i in range(300)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(60)]  # ties
    assert run(spark, rows, every=10) == brute(rows, 5, 10)


def test_blocks_meet_their_queries_in_every_partition(spark):
    rng = random.Random(6)
    rows = [(i, as_float([rng.gauss(0, 1) for _ in range(4)])) for i in range(200)]
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")  # as on tables too large for one partition
    try:
        assert run(spark, rows, every=10) == brute(rows, 5, 10)
    finally:
        spark.conf.set(coalesce, before)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (50, [0.0, 0.0]), (1, None), (2, [None, 1.0]), (100, [nan, 1.0]), (3, [inf, 1.0]), (4, []), (5, [3.0]),
        (None, [1.0, 1.0]), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (-50, [-1.0, -1.0]), (50, [0.5, 0.5]), (7, [-0.001, 0.0]),
    ]
    assert run(spark, rows) == brute(rows, 5, 50)


def test_components_of_a_vector_that_takes_no_part_need_not_fit(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e30, float("nan")]), (2, [-1e30, None]), (3, [2.0, 2.0])]
    assert run(spark, rows) == [(0, 1, 3, 6 * 256 * 256)]


def test_few_and_no_vectors(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(1, [1.0]), (2, [2.0])]) == []
    assert run(spark, [(0, [1.0]), (2, [2.0])]) == [(0, 1, 2, 131072)]


def test_the_search_stops_before_it_has_scored_all():
    rng = np.random.default_rng(2)
    matrix = np.floor(256 * rng.pareto(2, (4000, 4))).astype(np.int64)
    order = np.argsort(matrix, axis=0, kind="stable").astype(np.int32)
    ids, query = np.arange(4000), matrix[0]
    best, scores, scored = topk.threshold_search(matrix, order, ids, query, 5, 0)
    every = matrix @ query
    every[0] = -1
    wanted = np.lexsort((ids, -every))[:5]
    assert best.tolist() == wanted.tolist() and scores.tolist() == every[wanted].tolist() and scored < 1000


def test_scores_that_do_not_fit_are_an_error():
    big = np.full((2, 1), 2**40, np.int64)
    with pytest.raises(ArithmeticError):
        topk.threshold_search(big, np.array([[0], [1]]), np.arange(2), big[0], 1)
