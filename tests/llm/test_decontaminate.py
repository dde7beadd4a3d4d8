import re

import pytest
from llm_fixtures import PASSAGE, TEXTS, documents, empty, sentence

from tersa.llm.common import Scratch
from tersa.llm.decontaminate import contaminated, contamination

ITEMS = [
    ("a", PASSAGE), ("a", PASSAGE), ("b", "alpha, beta: " + PASSAGE.upper()), (None, sentence(4, 20)), ("c", None),
    ("d", ""), ("e", "One TWO three"), ("f", "one"), ("g", "... !!"), ("h", "漢字"), ("i", sentence(77, 13)),
    ("j", " ".join(["x"] * 13)), ("k", "x y z w"),
]


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text, items):
    own, hit, found = words(text), set(), set()
    for item, passage in items:
        w = words(passage)
        m = min(13, len(w))
        windows = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(own) - m + 1):
            if tuple(own[i : i + m]) in windows:
                hit.update(range(i, i + m))
                found.add(item or "")
    return len(own), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(own)


def rows_of(out):
    got = out.withColumn("bad", contaminated()).collect()
    return sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r["items"]), r.bad) for r in got)


@pytest.mark.parametrize("extra", [[], [(50, "x " * 400), (51, " ".join(w for _, w in ITEMS if w))]])
def test_against_brute_force(spark, extra):
    bench = spark.createDataFrame([(i, t, "n") for i, t in ITEMS], "item_id string, text string, n_words string")
    texts = TEXTS + extra
    out, hits = contamination(documents(spark, texts), bench, Scratch(spark, "t"))
    wanted = [(str(i), *brute(t, ITEMS)) for i, t in texts]
    assert rows_of(out) == sorted((i, n, h, tuple(f), b) for i, n, h, f, b in wanted)
    assert hits.columns == ["length", "words", "_row", "start", "items"] or "words" in hits.columns


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    out, _ = contamination(documents(spark), none, Scratch(spark, "t"))
    assert {(r.n_hit, r.n_items) for r in out.collect()} == {(0, 0)} and out.count() == len(TEXTS)
    out, _ = contamination(empty(spark), none, Scratch(spark, "t"))
    assert out.count() == 0
