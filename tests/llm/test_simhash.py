import random
import re

import pytest
import xxhash
from llm_fixtures import TEXTS, documents, empty, sentence

from tersa.llm import simhash
from tersa.llm.common import Scratch


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, distance=4):
    """rows: (id, fingerprint) -> the smallest id each row reaches."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [least.get(find(i)) for i in range(len(rows))]


def test_awkward_documents(spark):
    wanted = [(i, brute_fingerprint(t)) for i, t in TEXTS]
    found = simhash.near_duplicates(documents(spark), Scratch(spark, "t")).collect()
    got = sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in found)
    assert got == sorted((str(i), fp, str(c)) for (i, fp), c in zip(wanted, brute_components(wanted)))


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    found = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs, Scratch(spark, "t")).collect()}
    assert found == {i: (fp, c) for (i, fp), c in zip(rows, brute_components(rows))}


@pytest.mark.parametrize("distance,block", [(4, 8192), (2, 8192), (4, 20)])
def test_links_connect_all_near_fingerprints(spark, distance, block, monkeypatch):
    """Chains of near fingerprints, a hot ball around one, and single ones; also with tiny blocks."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    rng = random.Random(distance)
    fps = {rng.getrandbits(64) for _ in range(150)}
    centre = rng.getrandbits(64)
    for _ in range(150):
        fps.add(centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    for fp in list(fps)[:60]:
        for _ in range(3):
            for _ in range(rng.randrange(1, 6)):
                fp ^= 1 << rng.randrange(64)
            fps.add(fp)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp bigint")
    scratch = Scratch(spark, "t")
    edges = scratch.keep(simhash.links(df, scratch, distance), "links")
    pairs = [(r.a % 2**64, r.b % 2**64) for r in edges.collect()]
    assert all((a ^ b).bit_count() <= distance for a, b in pairs)
    place = {f: i for i, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(place[a]), find(place[b])
        root[max(x, y)] = min(x, y)
    least = {}
    for i in range(len(fps)):
        least.setdefault(find(i), i)
    assert [least[find(i)] for i in range(len(fps))] == brute_components([(i, f) for i, f in enumerate(fps)], distance)


def test_one_of_each_keeps_the_smallest_id_once(spark):
    texts = [(3, sentence(1, 50)), (1, sentence(1, 50)), (1, sentence(1, 50)), (2, sentence(2, 50)), (4, None), (5, "")]
    docs = documents(spark, texts)
    kept = simhash.one_of_each(docs, Scratch(spark, "t"))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]


def test_empty(spark):
    assert simhash.near_duplicates(empty(spark), Scratch(spark, "t")).count() == 0
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "fp bigint"), Scratch(spark, "t"), 0)
