import zlib

import numpy as np
import pytest
from llm_fixtures import TEXTS, documents, empty

from tersa.llm import quality
from tersa.llm.common import Scratch


def test_features_match_plain_python():
    texts = [t or "" for _, t in TEXTS]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    x = quality.text_features(data, offsets)
    for row, b in zip(x, raw):
        f = dict(zip(quality.NAMES, row))
        w, lines = b.lower().split(), [q for q in b.split(b"\n") if q]
        assert f["bytes"] == pytest.approx(np.log1p(len(b)))
        assert f["words"] == pytest.approx(np.log1p(len(w)))
        if w:
            assert f["word_mean"] == pytest.approx(np.mean([len(q) for q in w]))
            assert f["distinct_words"] == pytest.approx(len(set(w)) / len(w))
            assert f["top_word"] == pytest.approx(max(map(w.count, set(w))) / len(w))
            assert f["upper"] == pytest.approx(sum(65 <= q <= 90 for q in b) / len(b))
        if lines:
            assert f["repeated_lines"] == pytest.approx(1 - len(set(lines)) / len(lines))


def test_tables_find_curves_and_interactions():
    rng = np.random.default_rng(1)
    x = rng.random((6000, 4))
    truth = 3 * np.sin(6 * x[:, 0]) + 4 * ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)) - 2
    y = (rng.random(6000) < 1 / (1 + np.exp(-truth))).astype(float)
    loss = lambda m: -np.mean(y[4000:] * np.log(m.score(x[4000:])) + (1 - y[4000:]) * np.log(1 - m.score(x[4000:])))
    alone, paired = (quality.fit(x[:4000], y[:4000], pairs=k) for k in (0, 3))
    assert loss(paired) < loss(alone) - 0.15
    assert {(i, j) for i, j, _ in paired.pairs} >= {(2, 1)}


def test_held_out_accuracy_and_rows(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    labels = {r.doc_id: r.quality for r in read("labels").collect()}
    rows = quality.classify(read("documents"), read("labels"), Scratch(spark, "t")).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score >= quality.THRESHOLD) == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and np.mean(held) > 0.95


def test_held_out_labels_are_not_learnt(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(200)])
    held = {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}
    one = spark.createDataFrame([(i, int(i % 3 > 0), "x") for i in range(200)], "doc_id bigint, quality int, score string")
    two = spark.createDataFrame([(i, int(i % 3 == 0 if i in held else i % 3 > 0), "x") for i in range(200)], "doc_id bigint, quality int, score string")
    first, second = ({r.doc_id: r.score for r in quality.classify(docs, k, Scratch(spark, "t")).collect()} for k in (one, two))
    assert first == second


@pytest.mark.parametrize("rows", [[], [(None, 1), (3, None), (6, 7)], [(6, 1), (7, 1), (8, 1)]])
def test_few_labels_and_awkward_texts(spark, rows):
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int")
    scored = quality.classify(documents(spark), labels, Scratch(spark, "t")).collect()
    assert len(scored) == len(TEXTS) and len({r.score for r in scored}) == 1 and 0 < scored[0].score < 1
    assert quality.classify(empty(spark), labels, Scratch(spark, "t")).count() == 0
