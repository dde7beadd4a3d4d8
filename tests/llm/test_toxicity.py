import random
import time
import zlib

import numpy as np
import pytest
from llm_fixtures import TEXTS, documents, empty, sentence

from tersa.llm import toxicity
from tersa.llm.common import Scratch


def brute_segments(scores):
    """Maximal segments by their definition: the best one, then those left and right of it."""
    total, best, low, at = 0.0, (0.0, 0, 0), 0.0, 0
    for i, s in enumerate(scores):
        total += s
        if total - low > best[0] + 1e-9:
            best = (total - low, at, i + 1)
        if total < low - 1e-9 or total <= low:
            low, at = total, i + 1
    if best[0] <= 0:
        return []
    score, a, b = best
    left, right = brute_segments(scores[:a]), brute_segments(scores[b:])
    return left + [(a, b, score)] + [(b + p, b + q, s) for p, q, s in right]


@pytest.mark.parametrize("seed", range(60))
def test_linear_scan_finds_every_maximal_segment(seed):
    rng = random.Random(seed)
    scores = [rng.choice([-3, -2, -1, 1, 2, 4]) + rng.random() / 1000 for _ in range(rng.randrange(0, 40))]
    total = np.concatenate(([0], np.cumsum(scores)))
    runs, i = [], 0
    while i < len(scores):
        if scores[i] > 0:
            j = i
            while j < len(scores) and scores[j] > 0:
                j += 1
            runs.append((i, j))
            i = j
        else:
            i += 1
    found = toxicity.maximal_segments([(total[a], total[b]) for a, b in runs])
    got = [(runs[p][0], runs[q][1], pytest.approx(s)) for p, q, s in found]
    assert brute_segments(scores) == got


def test_a_million_runs_are_scanned_in_seconds():
    """Sums that fall through the text: every run starts lower than all before it, or higher than the last but lower than none."""
    down = [(-3.0 * i, -3.0 * i + 2) for i in range(10**6)]
    saw = [(-i % 1000 - i / 1e4, -i % 1000 - i / 1e4 + 0.5) for i in range(10**6)]
    began = time.process_time()
    assert len(toxicity.maximal_segments(down)) == 10**6
    assert len(toxicity.maximal_segments(saw)) > 1000
    assert len(toxicity.maximal_segments([(float(i), i + 0.9) for i in range(10**6)])) == 1
    assert time.process_time() - began < 60


def test_held_out_accuracy(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    labels = {r.doc_id: r.toxic for r in read("labels").collect()}
    rows = toxicity.assess(read("documents"), read("labels"), Scratch(spark, "t")).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(r.score >= toxicity.THRESHOLD, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) > 0.97
    assert sum(p and y for p, y in held) > 0.9 * sum(y for _, y in held)


def test_passages_and_held_out_labels(spark):
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(400):
        words = sentence(i, 60).split()
        if i % 5 == 0:
            at = rng.randrange(50)
            words[at:at] = ["vile", "awful", "scum"]
        texts.append((i, " ".join(words)))
        held = zlib.crc32(str(i).encode()) % 4 == 2
        labels.append((i, 1 - int(i % 5 == 0) if held else int(i % 5 == 0), "x"))
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int, score string")
    rows = toxicity.assess(documents(spark, texts), known, Scratch(spark, "t")).collect()
    for r in rows:
        assert (r.score >= toxicity.THRESHOLD) == (r.doc_id % 5 == 0)
        words = dict(texts)[r.doc_id].split()
        assert all(set(words[p.first : p.end]) & {"vile", "awful", "scum"} for p in r.passages)
        assert bool(r.passages) == (r.doc_id % 5 == 0)


@pytest.mark.parametrize("rows", [[], [(None, 1), (3, None), (6, 7)], [(7, 1), (8, 1)], [(0, 1), (2, 0), (1, 1), (6, 0)]])
def test_few_labels_and_awkward_texts(spark, rows):
    labels = spark.createDataFrame(rows, "doc_id bigint, toxic int")
    scored = toxicity.assess(documents(spark), labels, Scratch(spark, "t")).collect()
    assert len(scored) == len(TEXTS) and all(0 < r.score < 1 for r in scored)
    assert toxicity.assess(empty(spark), labels, Scratch(spark, "t")).count() == 0
