import random

import numpy as np
import pytest
from llm_fixtures import PASSAGE, TEXTS, documents, empty, sentence

from tersa.llm import induced_sort, suffix_dedup
from tersa.llm.common import Scratch


def brute(rows):
    """rows: (id, text) -> (bytes, removed, spans, kept bytes)."""
    last = float("inf")
    holder = {}
    raw = [(last if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for k in range(len(b) - 49):
            holder[b[k : k + 50]] = min(i, holder.get(b[k : k + 50], last))
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if holder[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        spans = sum(g and not p for p, g in zip([False, *gone], gone))
        out.append((len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def check(spark, rows):
    done = suffix_dedup.remove_repeats(documents(spark, rows), Scratch(spark, "t")).collect()
    got = sorted((str(r.doc.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in done)
    assert got == sorted((str(i), *w) for (i, _), w in zip(rows, brute(rows)))


def test_awkward_documents(spark):
    check(spark, TEXTS)


def test_periodic_overlapping_and_nested_repeats(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abc ") for _ in range(400))
    rows = [(i, "".join(base[a : a + rng.randrange(40, 140)] for a in rng.choices(range(300), k=rng.randrange(1, 6)))) for i in range(60)]
    rows += [(60, "ab" * 700), (61, "x" + "ab" * 300), (62, "é" * 120), (63, "zé" + "é" * 60), (64, base), (-5, base[:200]), (None, base)]
    check(spark, rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    done = {r.doc.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, Scratch(spark, "t")).collect()}
    assert done == {i: w for (i, _), w in zip(rows, brute(rows))}


def test_documents_lose_only_whole_characters(spark):
    shared = "ñandú çedilla " * 6
    rows = [(1, "ä" + shared + "ö"), (2, "ã" + shared + "õ"), (3, PASSAGE), (4, sentence(3, 9) + " " + PASSAGE), (5, None), (6, PASSAGE)]
    docs = documents(spark, rows)
    out = suffix_dedup.without_repeats(docs, Scratch(spark, "t"))
    assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
    kept = {r.doc_id: r for r in out.collect()}
    assert kept[1].text == "ä" + shared + "ö" and kept[2].text == "ãõ" and kept[5].text is None
    assert kept[6].text == "" and kept[6].n_chars == 0 and kept[4].text == sentence(3, 9) + " "


def test_empty(spark):
    assert suffix_dedup.remove_repeats(empty(spark), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_induced_order_and_prefixes(seed):
    rng, depth = random.Random(seed), induced_sort.DEPTH
    symbols, text = rng.choice([1, 2, 3, 10]), []
    pool = [[rng.randrange(1, 1 + symbols) for _ in range(rng.randrange(1, 60))] for _ in range(3)]
    for _ in range(rng.randrange(1, 8)):
        for _ in range(rng.randrange(1, 4)):
            text += rng.choice(pool) if rng.random() < 0.7 else [rng.randrange(1, 1 + symbols) for _ in range(rng.randrange(1, 50))]
        text.append(0)
    raw = bytes(text) + b"\xff" * 100
    got, prefixes = [], []
    for position, prefix in induced_sort.sorted_suffixes(np.array(text, np.uint8), rng.choice([50, 1000, 1 << 20])):
        got += position.tolist()
        prefixes += prefix.tolist()
    wanted = sorted((i for i, c in enumerate(text) if c), key=lambda i: raw[i : i + depth], reverse=True)
    assert sorted(got) == sorted(wanted)
    assert [raw[i : i + depth] for i in got] == [raw[i : i + depth] for i in wanted]
    for a, b, n in zip(got, got[1:], prefixes[1:]):
        if raw[a] == raw[b]:
            assert n == next((k for k in range(depth) if raw[a + k] != raw[b + k]), depth)


def test_queues_keep_their_order_on_disk():
    queues = induced_sort.DiskQueues(100)
    for k in range(30):
        queues.put(k % 3, np.arange(k, k + 4), np.full(4, k, np.uint8))
    assert queues.file is not None
    for symbol in range(3):
        position, prefix = queues.take(symbol)
        assert position.tolist() == [p for k in range(symbol, 30, 3) for p in range(k, k + 4)]
        assert prefix.tolist() == [k for k in range(symbol, 30, 3) for _ in range(4)]
