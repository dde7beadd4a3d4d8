"""Toxicity by maximum-scoring segments.

A token is a word or its first bytes (a stem). It scores its log-odds between toxic and other labelled documents,
under a Dirichlet prior in proportion to its count in the whole corpus, taken towards zero by its standard error.
A word scores what the worst of its tokens does, lowered by a small drift. One scan over a document finds every maximal scoring segment. Segment scores follow an extreme-value law; its scale
comes from the word scores of the corpus, its location from documents that are labelled clean. What the segments
say beyond chance is turned into a probability on the labelled sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersa.llm.common import Scratch, Words, arrow_map, chunks, hold, lower_ascii, mix, text_column

#: Labelled rows to learn from at most: those with the smallest hashes of their keys.
SAMPLE_ROWS = 60_000
#: Tokens are counted in so many cells, by hash.
CELLS = 1 << 20
#: Bytes of the stems; a word that is no longer is its own stem.
STEMS = (5, 6, 7, 8)
PRIOR_WORDS = 2000.0
ERRORS = 3.0
DRIFT = 0.05
THRESHOLD = 0.3


def _letters() -> np.ndarray:
    inside = np.zeros(256, bool)
    inside[97:123] = inside[128:] = True
    return inside


def _cells(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, list[np.ndarray]]:
    """The words, and their cells: as words, and as stems of each length."""
    words = Words(data, offsets, _letters(), lower_ascii())
    kinds = [words.hashes(), *(mix(words.hashes(n) + np.uint64(n)) for n in STEMS)]
    return words, [(h & np.uint64(CELLS - 1)).astype(np.int64) for h in kinds]


def held_out_rows(key: Column) -> Column:
    """The rows whose labels are never learnt from; a null key is none of them."""
    return F.coalesce(hold(key) % 4 == 2, F.lit(False))


def word_counts(docs: DataFrame, known: dict[int, int], key: str = "doc_id") -> np.ndarray:
    """By cell: counts in documents labelled 0, in documents labelled 1, and in the whole corpus.

    In a labelled document the n-th occurrence counts about 1/n, so that no document makes a word toxic by
    repeating it. ``known`` is the bounded labelled sample.
    """
    spark = docs.sparkSession
    ids = np.array(sorted(known), np.int64)
    shared = spark.sparkContext.broadcast((ids, np.array([known[i] for i in ids.tolist()], np.int64)))

    def count(batches):
        ids, labels = shared.value
        total = np.zeros((3, CELLS))
        for batch in batches:
            data, offsets = text_column(batch)
            keys = batch.column(0).cast(pa.int64())
            none = np.asarray(keys.is_null())
            keys = keys.fill_null(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, keys), max(len(ids) - 1, 0))
            label = np.where((ids[at] == keys) & ~none, labels[at], 2) if len(ids) else np.full(len(keys), 2)
            for a, b in chunks(offsets):
                words, cells = _cells(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                of = label[a:b][words.row]
                known = [np.flatnonzero(of == k) for k in (0, 1)]
                for kind in cells:
                    for k in (0, 1):
                        pairs, times = np.unique(words.row[known[k]] * CELLS + kind[known[k]], return_counts=True)
                        np.add.at(total[k], pairs % CELLS, 1 + np.log(times))
                    np.add.at(total[2], kind, 1)
        used = np.flatnonzero(total[2])
        for a in range(0, len(used), 1 << 16):
            part = used[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(t[part]) for t in total)], names=["cell", "c0", "c1", "c2"])

    counted = arrow_map(docs.select(key, "text"), count, "cell bigint, c0 double, c1 double, c2 double")
    summed = counted.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("c0", "c1", "c2")]).toArrow()  # at most CELLS rows
    out = np.zeros((3, CELLS))
    for k in range(3):
        out[k, summed.column("cell").to_numpy()] = summed.column(f"c{k}").to_numpy()
    return out


def word_scores(counts: np.ndarray) -> np.ndarray:
    """The score of every cell."""
    clean, toxic, every = counts.astype(float)
    prior = PRIOR_WORDS * (every + 0.01) / (every.sum() + 0.01 * CELLS)
    odds = lambda n: np.log((n + prior) / (n.sum() + PRIOR_WORDS - n - prior))
    delta = odds(toxic) - odds(clean)
    error = np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    return np.sign(delta) * np.maximum(np.abs(delta) - ERRORS * error, 0)


def maximal_segments(sums: list[tuple[float, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, in linear time.

    ``sums``: for each run of positive words, the sum of scores before and after it. Returns first run, last run
    and score. A run joins the last segment that starts from a lower sum and ends below this one's.
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, the nearest one that starts lower
    for i, (before, after) in enumerate(sums):
        first, low, j = i, before, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]  # all in between start as high as this one
            if j < 0 or found[j][3] >= after:
                found.append((first, i, low, after, j))
                break
            first, low, link = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = link
    return [(a, b, high - low) for a, b, low, high, _ in found]


@dataclass
class Calibration:
    """Segment scores s in n words: chance makes K * n * exp(-scale * s) of them."""

    scale: float = 1.0
    log_k: float = 0.0
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)


def _scale(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of sum p * exp(scale * score) = 1."""
    p = counts / max(counts.sum(), 1)
    if not p[scores > 0].sum():
        return 1.0
    total = lambda x: float(np.sum(p * np.exp(np.minimum(x * scores, 500)))) - 1
    low, high = 1e-6, 1.0
    while total(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < 0 else (low, mid)
    return high


def passages(docs: DataFrame, scores: np.ndarray, key: str = "doc_id") -> DataFrame:
    """(key, n_words, segments): every maximal segment of each text, by first word, end word and score."""
    shared = docs.sparkSession.sparkContext.broadcast(scores)

    def scan(batches):
        table = shared.value
        for batch in batches:
            data, offsets = text_column(batch)
            for a, b in chunks(offsets):
                words, cells = _cells(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                value = np.max([table[kind] for kind in cells], axis=0) - DRIFT if len(words.row) else np.zeros(0)
                total = np.concatenate(([0], np.cumsum(value)))
                good = value > 0
                start, end = good.copy(), good.copy()
                start[1:] &= ~(good[:-1] & (words.row[1:] == words.row[:-1]))
                end[:-1] &= ~(good[1:] & (words.row[1:] == words.row[:-1]))
                start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
                row = words.row[start] if len(start) else np.zeros(0, np.int64)
                edge = np.searchsorted(row, np.arange(words.rows + 1))
                found, number = [], np.zeros(words.rows, np.int64)
                for r in np.unique(row):
                    i, j, base = edge[r], edge[r + 1], words.first[r]
                    own = maximal_segments(list(zip(total[start[i:j]].tolist(), total[end[i:j]].tolist())))
                    found += [(int(start[i + p] - base), int(end[i + q] - base), s) for p, q, s in own]
                    number[r] = len(own)
                columns = list(zip(*found)) if found else ([], [], [])
                parts = pa.StructArray.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                    names=["first", "end", "score"],
                )
                ends = pa.array(np.concatenate(([0], np.cumsum(number))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(words.counts, pa.int64()), pa.ListArray.from_arrays(ends, parts)],
                    names=[key, "n_words", "segments"],
                )

    kind = docs.schema[key].dataType.simpleString()
    spans = "array<struct<first: bigint, end: bigint, score: double>>"
    return arrow_map(docs.select(key, "text"), scan, f"{key} {kind}, n_words bigint, segments {spans}")


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights (the first is the constant) by Newton's method with a small ridge."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(design.shape[1])
    ridge = np.diag([1e-6, *[0.1] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + ridge, design.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def assess(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, label: str = "toxic", held_out=held_out_rows,
    sample_rows: int = SAMPLE_ROWS, key: str = "doc_id",
) -> DataFrame:
    """(key, held_out, score, n_words, passages): the probability of label 1, and each passage beyond chance.

    A passage has its first word, end word and evidence in nats. Null and empty texts have no passages and are
    scored as such. Null labels and keys teach nothing; of labels that repeat a key the largest counts. Without
    labels of both kinds the score is the smoothed share of ones. Repeated rows are scored one by one; an empty table gives no
    rows. A very long text is scanned in one task, in time linear in its words. Other columns are not read, whatever their names.
    """
    known = labels.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(sample_rows)
    sample = {r.id: r.y for r in known.collect()}  # at most ``sample_rows``
    positive, n = sum(sample.values()), len(sample)
    share = float(np.log((positive + 1) / (n - positive + 1)))
    both = 0 < positive < n
    counts = word_counts(docs, sample, key) if both else np.zeros((3, CELLS))
    scores = word_scores(counts) if both else np.zeros(CELLS)
    found = scratch.keep(passages(docs, scores, key), "passages")
    # chance is clean text, with a little of everything that the corpus holds
    background = counts[0] + PRIOR_WORDS * counts[2] / max(counts[2].sum(), 1)
    law = Calibration(_scale(scores - DRIFT, background), 0.0, (share, 0.0, 0.0, 0.0))
    best = F.coalesce(F.array_max(F.transform("segments", lambda s: s["score"])), F.lit(0.0))

    def described(law):
        value = lambda s: F.lit(law.scale) * s["score"] - F.lit(law.log_k) - F.log(F.greatest("n_words", F.lit(1)))
        sure = F.filter(F.transform("segments", lambda s: F.struct(s["first"].alias("first"), s["end"].alias("end"), value(s).alias("evidence"))), lambda s: s["evidence"] > 0)
        top = F.greatest(F.lit(-10.0), F.lit(law.scale) * best - F.lit(law.log_k) - F.log(F.greatest("n_words", F.lit(1))))
        rest = F.aggregate(sure, F.lit(0.0), lambda t, s: t + s["evidence"])
        return sure, F.least(top, F.lit(30.0)), F.log1p(rest), F.log1p("n_words")

    if both:
        ids = docs.sparkSession.createDataFrame(pa.table({"_id": pa.array(list(sample), pa.int64()), "_y": pa.array(list(sample.values()), pa.int32())}))
        learnt = found.join(ids, found[key].cast("long") == ids["_id"])
        clean = learnt.where("_y = 0").select(best.alias("s"), "n_words").toArrow()  # bounded by the sample
        s, words = clean.column("s").to_numpy(), clean.column("n_words").to_numpy()
        use = s > 0
        if use.any():  # the mean of an extreme-value law lies Euler's constant above its location
            law.log_k = float(np.mean(law.scale * s[use] - np.log(np.maximum(words[use], 1))) - np.euler_gamma)
        _, top, rest, size = described(law)
        table = learnt.select(top.alias("top"), rest.alias("rest"), size.alias("size"), "_y").toArrow()
        x = np.column_stack([table.column(c).to_numpy() for c in ("top", "rest", "size")])
        y = table.column("_y").to_numpy().astype(float)
        order = np.lexsort((*x.T, y))
        law.weights = _logistic(x[order], y[order])
    sure, top, rest, size = described(law)
    w = [F.lit(v) for v in law.weights]
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(w[0] + w[1] * top + w[2] * rest + w[3] * size)))
    return found.select(key, held_out(F.col(key)).alias("held_out"), score.alias("score"), "n_words", sure.alias("passages"))


def flagged(score="score", threshold: float = THRESHOLD):
    return F.col(score) >= threshold
