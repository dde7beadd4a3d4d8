"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits feature after feature with shallow trees on its bins; their sum is one lookup
table per feature. Pairs that explain most of what is left get a two-way table. A score is a sum of
looked-up numbers. Features are counts over the whole text, computed for all documents; the model is
fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersa.llm.common import Scratch, Words, arrow_map, chunks, hold, lower_ascii, mix, text_column

#: Labelled rows the model is fitted on at most; of more, those with the smallest hashes of their keys.
SAMPLE_ROWS = 60_000
THRESHOLD = 0.3

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9), "line": (10,),
    "stop": b".?", "comma": b",;:", "bang": b"!", "bar": b"|", "odd": b"#$%&*+<=>@[\\]^_`{}~/", "other": range(128, 256),
    "bracket": b"()'\"-", "control": (*range(9), *range(11, 32), 127),
}
NAMES = [
    "bytes", "words", "word_mean", "word_sd", "word_max", "lines", "line_mean", "distinct_words", "top_word",
    "repeated_lines", "short_words", "long_words", "marked_words", "same_next", *_CLASSES,
]


def _class_table() -> np.ndarray:
    table = np.zeros((256, len(_CLASSES)))
    for i, members in enumerate(_CLASSES.values()):
        table[list(members), i] = 1
    return table


def _repeats(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's number of distinct values, and the count of its most frequent one."""
    if not len(row):
        return np.zeros(rows), np.zeros(rows)
    spread = np.sort(mix(value ^ mix(row.astype(np.uint64))) >> np.uint64(20) | row.astype(np.uint64) << np.uint64(44))
    first = np.flatnonzero(np.concatenate(([True], spread[1:] != spread[:-1])))
    run, of = np.diff(np.append(first, len(spread))), (spread[first] >> np.uint64(44)).astype(np.int64)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, of, run)
    return np.bincount(of, minlength=rows), top


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``NAMES`` for each text; an empty text has zeros."""
    rows, size = len(offsets) - 1, np.diff(offsets).astype(float)
    byte_row = np.repeat(np.arange(rows), np.diff(offsets))
    counts = np.bincount(byte_row * 256 + data, minlength=rows * 256).reshape(rows, 256)
    kinds = counts @ _class_table()
    not_space = np.ones(256, bool)
    not_space[[9, 10, 11, 12, 13, 32]] = False
    not_line = np.arange(256) != 10
    words = Words(data, offsets, not_space, lower_ascii())
    length = (words.ends - words.starts).astype(float)
    n = np.maximum(words.counts, 1)
    total = lambda x: np.bincount(words.row, x, minlength=rows)
    mean = total(length) / n
    sd = np.sqrt(np.maximum(total(length**2) / n - mean**2, 0))
    longest = np.zeros(rows)
    np.maximum.at(longest, words.row, length)
    hashes = words.hashes()
    distinct, top = _repeats(words.row, hashes, rows)
    lines = Words(data, offsets, not_line, np.arange(256, dtype=np.uint8))
    lines_distinct, _ = _repeats(lines.row, lines.hashes(), rows)
    last = words.data[words.ends - 1] if len(words.ends) else words.data[:0]
    marked = ~((last >= 97) & (last <= 122) | (last >= 128) | (last >= 48) & (last <= 57))
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1])
    many_lines = np.maximum(lines.counts, 1)
    columns = [
        np.log1p(size), np.log1p(words.counts), mean, sd, np.log1p(longest), np.log1p(lines.counts),
        np.log1p(size / many_lines), distinct / n, top / n, 1 - lines_distinct / many_lines * (lines.counts > 0),
        total(length <= 3) / n, total(length >= 15) / n, total(marked) / n, total(same) / n,
    ]
    return np.column_stack([*columns, kinds / np.maximum(size, 1)[:, None]]) * (size > 0)[:, None]


def features(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, x): the features of every whole text; null and empty texts have zeros."""

    def scan(batches):
        for batch in batches:
            data, offsets = text_column(batch)
            x = [text_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets)]
            if x:
                flat = pa.array(np.concatenate(x).astype(np.float32).ravel())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(NAMES), dtype=np.int32)), flat),
                ], names=[key, "x"])

    return arrow_map(docs.select(key, "text"), scan, f"{key} {docs.schema[key].dataType.simpleString()}, x array<float>")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray, reg: float) -> tuple[int, float]:
    """Where to cut a row of bins in two, and what that gains."""
    if len(g) < 2:
        return 0, 0.0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + reg) + right_g**2 / (right_h + reg) - g.sum() ** 2 / (h.sum() + reg)
    at = int(np.argmax(gain))
    return at + 1, float(gain[at])


def _tree(g: np.ndarray, h: np.ndarray, reg: float, depth: int = 2) -> np.ndarray:
    """The leaf value of each bin for a shallow tree on one feature."""
    cut, gain = _best_cut(g, h, reg) if depth else (0, 0.0)
    if not cut or gain <= 0:
        return np.full(len(g), -g.sum() / (h.sum() + reg))
    return np.concatenate([_tree(g[:cut], h[:cut], reg, depth - 1), _tree(g[cut:], h[cut:], reg, depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, reg: float) -> tuple[np.ndarray, float]:
    """Leaf values of a tree that cuts one feature, then the other on either side; and its gain."""
    best, gain_best = None, -1.0
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        cut, _ = _best_cut(a.sum(1), b.sum(1), reg)
        for cut in {cut, max(1, len(a) // 2)}:
            value, gain = np.empty_like(a), 0.0
            for part in (slice(0, cut), slice(cut, None)):
                pg, ph = a[part].sum(0), b[part].sum(0)
                value[part] = _tree(pg, ph, reg, 1)
                gain += _best_cut(pg, ph, reg)[1]
            if gain > gain_best:
                best, gain_best = (value.T if flip else value), gain
    return best, gain_best


@dataclass
class AdditiveModel:
    """Lookup tables: ``edges`` and ``tables`` by feature, ``pairs`` with coarse edges and two-way tables."""

    intercept: float = 0.0
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    coarse: list = field(default_factory=list)
    pairs: list = field(default_factory=list)  # (i, j, table)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        if self.pairs:
            bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.coarse)]
            for i, j, table in self.pairs:
                total += table[bins[i], bins[j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x))


def _quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins)) if len(x) else np.zeros(0)


def fit(
    x: np.ndarray, y: np.ndarray, bins: int = 48, pair_bins: int = 12, rounds: int = 120, pair_rounds: int = 60,
    pairs: int = 10, rate: float = 0.15, reg: float = 5.0,
) -> AdditiveModel:
    """Fit by cyclic boosting. Without rows, or with one class only, the score is the smoothed share of ones."""
    n, positive = len(y), float(np.sum(y))
    share = (positive + 1) / (n + 2)
    model = AdditiveModel(intercept=float(np.log(share / (1 - share))))
    if not 0 < positive < n:
        return model
    d, margin = x.shape[1], np.full(n, model.intercept)
    model.edges = [_quantile_edges(x[:, j], bins) for j in range(d)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]

    def sums(where, size):
        p = _sigmoid(margin)
        return np.bincount(where, p - y, minlength=size), np.bincount(where, p * (1 - p), minlength=size)

    for _ in range(rounds):
        for j in range(d):
            if len(model.edges[j]):
                step = rate * _tree(*sums(at[j], len(model.tables[j])), reg)
                model.tables[j] += step
                margin += step[at[j]]
    model.coarse = [_quantile_edges(x[:, j], pair_bins) for j in range(d)]
    few = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]
    shape = lambda i, j: (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)

    def pair_tree(i, j):
        r, c = shape(i, j)
        g, h = sums(few[i] * c + few[j], r * c)
        return _pair_tree(g.reshape(r, c), h.reshape(r, c), reg)

    gains = [(pair_tree(i, j)[1], i, j) for i in range(d) for j in range(i) if min(shape(i, j)) > 1]
    chosen = [(i, j, np.zeros(shape(i, j))) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    for _ in range(pair_rounds):
        for i, j, table in chosen:
            step = rate * pair_tree(i, j)[0]
            table += step
            margin += step[few[i], few[j]]
    model.pairs = chosen
    return model


def labelled_sample(rows: DataFrame, labels: DataFrame, label: str, held_out, limit: int, key: str = "doc_id") -> DataFrame:
    """Rows with their label, held-out rows left out, at most about ``limit`` by hash of the key.

    Null labels and keys are left out; repeated labels or rows count each.
    """
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_y"))
    known = known.where(F.col("_key").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_key")))
    n = known.count()
    if n > limit:
        known = known.where(F.pmod(F.xxhash64("_key", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * limit / n))
    return rows.join(known, rows[key] == known["_key"]).drop("_key")


def held_out_rows(key: Column) -> Column:
    """The rows whose labels are never learnt from; a null key is none of them."""
    return F.coalesce(hold(key) % 5 == 0, F.lit(False))


def learn(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, label: str = "quality", held_out=held_out_rows,
    sample_rows: int = SAMPLE_ROWS, key: str = "doc_id",
) -> tuple[AdditiveModel, DataFrame]:
    """The model, and the features of all documents."""
    table = scratch.keep(features(docs, key), "features")
    sample = labelled_sample(table, labels, label, held_out, sample_rows, key).select("x", "_y").toArrow()
    x = np.array(sample.column("x").combine_chunks().flatten(), np.float32).reshape(-1, len(NAMES))
    y = sample.column("_y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same model however rows arrive
    return fit(x[order], y[order]), table


def classify(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, label: str = "quality", held_out=held_out_rows,
    sample_rows: int = SAMPLE_ROWS, key: str = "doc_id",
) -> DataFrame:
    """(key, held_out, score): the probability of label 1 for every row; repeated rows are scored one by one.

    Null and empty texts are scored by their zero features. Without labels the score is a half; an empty table gives no rows.
    A very long text is read in one task. Other columns are not read, whatever their names.
    """
    fitted, table = learn(docs, labels, scratch, label, held_out, sample_rows, key)
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def score(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            scores = model.value.score(flat.reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = arrow_map(table, score, f"{key} {kind}, score double", rows=10_000)
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that score ``threshold`` or more, with the columns they have, whatever their names; rows are judged in place.

    Null text is judged as empty text. Repeated rows are judged alike; an empty table stays empty. A very long text is read in one task.
    """
    fitted, _ = learn(docs, labels, scratch, **options)
    scratch.drop("features")
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def judge(batches):
        for batch in batches:
            data, offsets = text_column(batch)
            for a, b in chunks(offsets):
                x = text_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).astype(np.float32)
                yield batch.slice(a, b - a).filter(pa.array(model.value.score(x) >= threshold))

    return arrow_map(docs, judge, docs.schema)


def accepted(score="score", threshold: float = THRESHOLD):
    return F.col(score) >= threshold
