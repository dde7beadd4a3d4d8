from llm_fixtures import TEXTS, documents, empty, sentence

from tersa.llm import paragraphs
from tersa.llm.common import Scratch


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute(texts):
    """The (id, text) that stay: of each class the smallest id, nulls last."""
    sets, root = [shingles(t) for _, t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) >= 0.8 * len(x | y):
                root = [root[j] if r == root[i] else r for r in root]
    return sorted(min((i is None, i or 0) for k, (i, _) in enumerate(texts) if root[k] == r) for r in set(root))


def kept(spark, texts):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in paragraphs.one_of_each(documents(spark, texts), Scratch(spark, "near")).collect())


def edited(seed, n, edits):
    words = sentence(seed, n).split()
    for k in range(edits):
        words[(2 * k + 1) * n // (2 * edits)] = f"edit{seed}"
    return " ".join(words)


def test_edited_copies_of_jaccard_from_four_fifths_go(spark):
    texts = [(i, sentence(i, 200)) for i in range(40)] + [(100 + i, edited(i, 200, 1 + i % 4)) for i in range(40)]
    assert len(brute(texts)) == 40
    assert kept(spark, texts) == brute(texts)


def test_less_similar_documents_stay(spark):
    texts = [(i, sentence(i, 200)) for i in range(10)] + [(100 + i, edited(i, 200, 6)) for i in range(10)]
    assert len(brute(texts)) == 20
    assert kept(spark, texts) == brute(texts)


def test_awkward_documents(spark):
    texts = [*TEXTS, (50, "ONE"), (51, "one two three"), (52, "one two"), (53, " ")]
    assert kept(spark, texts) == brute(texts)


def test_empty(spark):
    assert paragraphs.one_of_each(empty(spark), Scratch(spark, "near")).count() == 0
