import numpy as np
import pytest
from llm_fixtures import TEXTS, documents, empty, sentence

from tersa.llm import paragraphs
from tersa.llm.common import Scratch
from tersa.llm.queries import QUERIES


def brute(rows, threshold=0.8):
    """Every paragraph of five words or more, compared with every other: those in classes of two or more."""
    units = []
    for i, text in rows:
        for p, line in enumerate(x for x in (text or "").split("\n") if x):
            w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line).encode().split()]
            if len(w) >= 5:
                units.append((i, p, len(w), frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)), tuple(w)))
    root = list(range(len(units)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(units)):
        for b in range(a):
            x, y = units[a][3], units[b][3]
            if units[a][4] == units[b][4] or len(x & y) >= threshold * len(x | y) - 1e-9:
                root[find(a)] = find(b)
    classes = {}
    for k in range(len(units)):
        classes.setdefault(find(k), []).append(k)
    out = []
    for members in classes.values():
        if len(members) > 1:
            first = min(((units[k][0] is None, units[k][0] or 0, units[k][1]) for k in members))
            first_doc = None if first[0] else first[1]
            out += [(str(units[k][0]), units[k][1], units[k][2], str(first_doc), first[2], len(members)) for k in members]
    return sorted(out)


def run(spark, docs):
    rows = paragraphs.near_paragraphs(docs, Scratch(spark, "t")).collect()
    classes = {}
    for r in rows:
        classes.setdefault((r.class_doc, r.class_paragraph), []).append(r)
    for (doc, place), members in classes.items():
        kept = [r for r in members if not r.removed]
        assert [(r.doc_id, r.paragraph) for r in kept] == [(doc, place)]
    return sorted((str(r.doc_id), r.paragraph, r.n_words, str(r.class_doc), r.class_paragraph, r.copies) for r in rows)


def test_awkward_documents(spark):
    assert run(spark, documents(spark)) == brute(TEXTS)


@pytest.mark.parametrize("block", [4096, 8])
def test_edited_lines_chains_and_a_hot_line(spark, block, monkeypatch):
    monkeypatch.setattr(paragraphs, "BLOCK_ROWS", block)
    base = sentence(1, 60).split()
    rows = [(i, sentence(i + 50, 30) + "\nThe very same line of " + sentence(2, 9)) for i in range(40)]
    for i in range(30):  # one edit each: similar to the first, and less so to each other
        rows.append((100 + i, " ".join(base[:i] + ["edit"] + base[i + 1 :]) + "\n" + sentence(i + 200, 20)))
    rows.append((99, " ".join(base)))
    rows += [(None, " ".join(base)), (300, sentence(70, 4)), (301, sentence(70, 4))]
    assert run(spark, documents(spark, rows)) == brute(rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert run(spark, docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty(spark):
    assert paragraphs.near_paragraphs(empty(spark), Scratch(spark, "t")).count() == 0


def test_tuned_bands_reach_the_recall():
    for threshold, recall in [(0.8, 0.995), (0.9, 0.99), (0.5, 0.9)]:
        bands, rows = paragraphs.tune(threshold, recall, 64)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 64
    rng = np.random.default_rng(3)
    found = 0
    for _ in range(200):  # pairs of lines with a similarity of about 0.8
        words = [f"w{x}" for x in rng.integers(0, 10**6, 104)]
        other = words[:52] + ["edit"] * 2 + words[54:80] + ["edit"] + words[81:]
        raw = [" ".join(w).encode() for w in (words, other)]
        lines = paragraphs.Lines(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 5)
        a, b = lines.keys(*paragraphs.tune())
        found += bool((a == b).any())
    assert found >= 196


def words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()


def check_passages(rows, found, size=51):
    """Every run of ``size`` words that two rows hold is found; every word found lies in a run of half of it that they hold."""
    texts, part = [words(t) for _, t in rows], size // 2 + 1
    runs = [{n: [tuple(w[k : k + n]) for k in range(len(w) - n + 1)] for n in (size, part)} for w in texts]
    holders = {}
    for i, by in enumerate(runs):
        for n in by:
            for x in set(by[n]):
                holders.setdefault(x, set()).add(i)
    wanted, allowed = set(), set()  # (doc_id, its words, place)
    got = {(r.doc_id, k) for r in found for k in range(r.first_word, r.first_word + r.n_words)}
    for (i, _), by in zip(rows, runs):
        for k, x in enumerate(by[size]):
            if len(holders[x]) > 1:
                wanted.add((i, k))
                assert len({(i, j) for j in range(k, k + size)} & got) >= part
        allowed |= {(i, j) for k, x in enumerate(by[part]) if len(holders[x]) > 1 for j in range(k, k + part)}
    assert got <= allowed
    by_id = {}
    for (i, _), by in zip(rows, runs):
        by_id.setdefault(i, set()).update(by[part])
    for r in found:
        mine = [by for (i, _), by in zip(rows, runs) if i == r.doc_id]
        near = {x for by in mine for x in by[part][r.first_word : r.first_word + r.n_words - part + 1]}
        assert near & by_id[r.class_doc] and r.copies <= max(len(holders[x]) for x in near)
        assert r.class_doc == r.doc_id or r.removed and (r.doc_id is None or r.class_doc < r.doc_id)
    return {i for i, _ in wanted}


def test_query_finds_passages_inside_longer_lines(spark, tmp_path):
    cut, wrapped, near = sentence(500, 51), sentence(501, 70).split(), sentence(510, 200).split()
    rows = [
        *TEXTS, (100, sentence(502, 300) + " " + cut + " " + sentence(503, 300)), (101, sentence(504, 100) + " " + cut.upper()),
        (102, cut + "\n" + sentence(505, 9)), (103, sentence(506, 80) + " " + " ".join(cut.split()[:25]) + " end"),
        (104, " ".join(wrapped) + " " + sentence(507, 400)),
        (105, sentence(508, 60) + "\n" + "\n".join(" ".join(wrapped[k : k + 7]) for k in range(0, 70, 7))),
        (106, (cut + " ") * 3), (107, sentence(509, 90)), (108, sentence(509, 90).replace(" ", "\n")),
        (109, " ".join(wrapped[:55]) + " " + " ".join(wrapped[20:])), (110, (sentence(520, 60) + " ") * 4),
        *((200 + k, " ".join([*near[: 15 * k], "edit", *near[15 * k :]])) for k in range(12)),
    ]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op7_near_paragraphs"](spark, str(tmp_path)).collect()
    passages = [r for r in found if r.first_word is not None]
    assert check_passages(rows, passages) >= {100, 101, 102, 104, 105, 106, 107, 108, 109, *range(200, 212)}
    assert not {103, 110} & {r.doc_id for r in passages}
    assert {(r.first_word, r.n_words, r.class_doc, r.copies) for r in passages if r.doc_id == 107} & {(r.first_word, r.n_words, r.class_doc, r.copies) for r in passages if r.doc_id == 108}
    lines = [r for r in found if r.first_word is None]
    assert sorted((str(r.doc_id), r.paragraph, r.n_words, str(r.class_doc), r.class_paragraph, r.copies) for r in lines) == brute(rows)


def test_passages_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = paragraphs.near_paragraphs(docs, Scratch(spark, "t"), passage=51).where("first_word is not null").collect()
    assert check_passages([(r.doc_id, r.text) for r in docs.collect()], found)
