import zlib
from array import array
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import TEXTS, documents, empty
from tokenizers import Tokenizer

from tersa.llm import packing
from tersa.llm.common import Scratch


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def check_plan(rows, capacity):
    """Every sequence is filled gapless from 0, and sequences are numbered from 0."""
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(bins) == list(range(len(bins)))
    return len(bins)


def test_pieces_match_the_tokenizer_and_fill_sequences(spark, tokenizer):
    pieces = packing.token_pieces(documents(spark), keep_ids=True)
    rows = packing.pack(pieces, Scratch(spark, "t")).collect()
    got = Counter()
    by_doc = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, parts in by_doc.items():
        wanted = Counter()
        for i, text in TEXTS:
            if i == doc_id:
                ids = ids_of(tokenizer, text)
                first = len(ids) % 1024 or 1024
                cuts = [0, *range(first, len(ids) + 1, 1024)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    wanted[k, a, array("I", ids[a:b]).tobytes()] += 1
        got = Counter((r.piece, r.start, bytes(r.ids)) for r in parts)
        assert got == wanted, doc_id
    used = check_plan(rows, 1024)
    assert used == -(-sum(r.length for r in rows) // 1024)


def test_whole_table_has_the_tokenizer_s_ids(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in packing.token_pieces(docs).collect()}
    for r in docs.collect():
        ids = ids_of(tokenizer, r.text)
        first = len(ids) % 1024 or 1024
        for k, a in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[a : a + 1024] if k else ids[:first]
            assert got[r.doc_id, k] == (len(part), zlib.crc32(array("I", part).tobytes()))


@given(st.text(alphabet=" ab\n\t  é漢'1.<|>\r", max_size=40))
@settings(max_examples=300, deadline=None)
def test_remembered_words_give_the_same_ids(text):
    encode = packing.encoder(public_tokenizers.path(packing.VOCABULARY))
    assert encode(text) == encode.whole(text)


def test_an_empty_table_stays_empty(spark):
    assert packing.pack(packing.token_pieces(empty(spark)), Scratch(spark, "t")).count() == 0


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
@settings(max_examples=150, deadline=None)
def test_search_keeps_every_piece_and_never_adds_bins(sizes):
    start = packing.best_fit(sizes, 40)
    done = packing.local_search(start, 40)
    held = Counter()
    for pattern, bins in done.items():
        assert sum(pattern) <= 40
        for size in pattern:
            held[size] += bins
    assert held == Counter(sizes)
    squares = lambda p: sum(n * sum(k) ** 2 for k, n in p.items())
    assert sum(done.values()) <= sum(start.values()) and squares(done) >= squares(start)


def test_exchanges_empty_bins_that_best_fit_leaves():
    sizes = {300: 1000, 400: 1000, 500: 800}
    before, after = packing.best_fit(sizes, 1024), packing.local_search(packing.best_fit(sizes, 1024), 1024)
    assert sum(after.values()) < sum(before.values())
