import zlib
from collections import Counter

import pytest
from llm_fixtures import TEXTS, documents, empty, sentence

from tersa.llm import sharding
from tersa.llm.common import Scratch


def place(spark, texts, shards):
    rows = sharding.shard_documents(documents(spark, texts), Scratch(spark, "t"), shards).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts
    )
    sizes = Counter(r.shard for r in rows)
    counts = [sizes[s] for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    return rows


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_awkward_documents(spark, shards):
    place(spark, TEXTS, shards)


def spread(rows):
    parts = {}
    for r in rows:
        parts.setdefault(r.text_crc32, Counter())[r.shard] += 1
    return {k: c for k, c in parts.items() if sum(c.values()) > 1}


def test_small_groups_end_in_one_shard(spark):
    texts = [(i, sentence(i, 12)) for i in range(300)] + [(1000 + i, sentence(i % 20, 12)) for i in range(60)]
    parts = spread(place(spark, texts, 8))
    assert len(parts) == 20 and sum(len(c) > 1 for c in parts.values()) == 0


def test_a_group_of_a_third_fills_as_few_shards_as_it_can(spark):
    texts = [(i, sentence(i, 12)) for i in range(200)] + [(1000 + i, "the same") for i in range(100)]
    (parts,) = spread(place(spark, texts, 10)).values()
    assert len(parts) <= 4


def test_without_single_documents_pairs_still_meet(spark):
    texts = [(i, sentence(i % 100, 12)) for i in range(200)]
    parts = spread(place(spark, texts, 5))
    assert sum(len(c) == 1 for c in parts.values()) >= 80


def test_empty(spark):
    assert sharding.shard_documents(empty(spark), Scratch(spark, "t")).count() == 0


def test_a_group_of_a_third_in_forty_shards_fills_fourteen(spark):
    texts = [(i, sentence(i, 12)) for i in range(800)] + [(1000 + i, "the same") for i in range(400)]
    (parts,) = spread(place(spark, texts, 40)).values()
    assert len(parts) == 14
