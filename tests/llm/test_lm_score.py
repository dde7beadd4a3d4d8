import random

import numpy as np
from llm_fixtures import TEXTS, documents, empty, sentence

from tersa.llm import lm_score
from tersa.llm.common import Scratch


def small_batch(seed=0, n=40):
    rng = np.random.default_rng(seed)
    return rng.integers(0, lm_score.VOCABULARY, (2 * lm_score.REACH, n)), rng.integers(0, lm_score.VOCABULARY, n)


def test_probabilities_of_all_words_sum_to_one():
    model = lm_score.WindowNetwork.fresh(3)
    context, _ = small_batch(n=1)
    every = np.arange(lm_score.VOCABULARY)
    total = np.exp(model.log_probability(np.repeat(context, len(every), 1), every)).sum()
    assert abs(total - 1) < 1e-4


def test_gradients_match_differences():
    model, (context, target) = lm_score.WindowNetwork.fresh(1), small_batch()
    double = lm_score.WindowNetwork(*[a.astype(np.float64) for a in model.arrays()])
    rng = np.random.default_rng(2)
    for weight, gradient in zip(double.arrays(), double.gradients(context, target)):
        spots = np.flatnonzero(gradient.ravel())
        for k in rng.choice(spots, min(6, len(spots)), replace=False):
            at = np.unravel_index(k, weight.shape)
            old, step, loss = weight[at], 1e-3, []
            for delta in (step, -step):
                weight[at] = old + delta
                loss.append(-double.log_probability(context, target).mean())
            weight[at] = old
            assert abs((loss[0] - loss[1]) / (2 * step) - gradient[at]) < 2e-4


def test_windows_never_mix_texts():
    texts = [np.array([5, 6, 7], np.uint16), np.zeros(0, np.uint16), np.array([8], np.uint16)]
    context, target, row = lm_score._windows(texts)
    assert target.tolist() == [5, 6, 7, 8] and row.tolist() == [0, 0, 0, 2]
    assert context.T.tolist() == [[0, 0, 6, 7], [0, 5, 7, 0], [5, 6, 0, 0], [0, 0, 0, 0]]


def test_real_order_scores_above_shuffled_order(spark):
    rng = random.Random(0)
    chain = {w: rng.sample(range(40), 2) for w in range(40)}

    def text(n):
        out = [rng.randrange(40)]
        while len(out) < n:
            out.append(rng.choice(chain[out[-1]]))
        return [f"w{x}" for x in out]

    texts = [text(80) for _ in range(600)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(1000 + i, " ".join(rng.sample(t, len(t)))) for i, t in enumerate(texts[:50])]
    scored = {r.doc_id: r for r in lm_score.score_documents(documents(spark, rows), Scratch(spark, "t"), rounds=3, share=20_000).collect()}
    assert sum(scored[i].log_likelihood > scored[1000 + i].log_likelihood for i in range(50)) >= 49
    assert all(abs(r.per_word - r.log_likelihood / r.n_words) < 1e-9 for r in scored.values())


def test_awkward_and_empty(spark):
    docs = documents(spark)
    rows = lm_score.score_documents(docs, Scratch(spark, "t")).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in rows) == sorted((str(i), len((t or "").encode().split())) for i, t in TEXTS)
    for r in rows:
        assert (r.log_likelihood < 0 and r.per_word < 0) if r.n_words else (r.log_likelihood == 0 and r.per_word is None)
    again = lm_score.score_documents(docs, Scratch(spark, "t")).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert lm_score.score_documents(empty(spark), Scratch(spark, "t")).count() == 0
    assert sentence(1, 3) == sentence(1, 3)
