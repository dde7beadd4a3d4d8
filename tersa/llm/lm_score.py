"""Masked pseudo-likelihood of documents under a bidirectional window network.

The network predicts a word from the words on both sides of it: a hidden layer over one embedding for each
place in the window, then the word's class, then the word in its class. It is trained in numpy on all documents:
in every round, tasks start from one model, learn from their share of a shuffled, tokenised corpus and are
averaged by their words. A document's score is the sum of the log-probabilities of its words, each given all
the others near it.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersa.llm.common import Scratch, Words, arrow_map, chunks, lower_ascii, text_column, with_row

CLASSES = 32
VOCABULARY = CLASSES * CLASSES
#: Ids: 0 stands outside the text, then the most frequent words, then cells for all other words by hash.
FREQUENT = 767
HIDDEN = 32
REACH = 2
ROUNDS = 3
BATCH = 8192
#: Words that one task learns from in all rounds.
SHARE_WORDS = 4_000_000
RATE = 0.08


def _not_space() -> np.ndarray:
    inside = np.ones(256, bool)
    inside[[9, 10, 11, 12, 13, 32]] = False
    return inside


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    words = Words(data, offsets, _not_space(), lower_ascii())
    return words, words.hashes()


def frequent_words(docs: DataFrame, scratch: Scratch, most: int = FREQUENT) -> np.ndarray:
    """Hashes of the most frequent words of the whole corpus, sorted; ties go to the smaller hash."""

    def count(batches):
        held, size = [], 0

        def out():
            hashes, which = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            total = np.bincount(which, np.concatenate([c for _, c in held])).astype(np.int64)
            for a in range(0, len(hashes), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(hashes[a : a + 10_000].view(np.int64)), pa.array(total[a : a + 10_000])], names=["word", "n"])

        for batch in batches:
            data, offsets = text_column(batch)
            for a, b in chunks(offsets):
                _, hashes = _word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                held.append(np.unique(hashes, return_counts=True))
                size += len(held[-1][0])
            if size > 1 << 20:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    counted = arrow_map(docs.select("text"), count, "word bigint, n bigint")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return np.sort(top.select("word").toArrow().column("word").to_numpy().view(np.uint64))


def _ids(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    cells = VOCABULARY - 1 - FREQUENT
    ids = FREQUENT + 1 + (hashes % np.uint64(cells)).astype(np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        ids = np.where(frequent[at] == hashes, at + 1, ids)
    return ids.astype(np.uint16)


def tokenised(docs: DataFrame, frequent: np.ndarray, key: str = "doc_id") -> DataFrame:
    """(key, words, ids): each text's word ids as unsigned 16-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def scan(batches):
        for batch in batches:
            data, offsets = text_column(batch)
            for a, b in chunks(offsets):
                words, hashes = _word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids = _ids(hashes, shared.value).tobytes()
                parts = [ids[2 * p : 2 * q] for p, q in zip(words.first[:-1], words.first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(words.counts, pa.int64()), pa.array(parts, pa.binary())],
                    names=[key, "words", "ids"],
                )

    return arrow_map(docs.select(key, "text"), scan, f"{key} {docs.schema[key].dataType.simpleString()}, words bigint, ids binary")


@dataclass
class WindowNetwork:
    """All weights in single precision; ``embed`` has a table for each place of the window."""

    embed: np.ndarray  # places, vocabulary, hidden
    bias: np.ndarray  # hidden
    to_class: np.ndarray  # hidden, classes
    class_bias: np.ndarray
    to_word: np.ndarray  # classes, hidden, words of a class
    word_bias: np.ndarray  # classes, words of a class

    @classmethod
    def fresh(cls, seed: int = 0) -> WindowNetwork:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        zero = lambda *shape: np.zeros(shape, np.float32)
        return cls(draw(2 * REACH, VOCABULARY, HIDDEN), zero(HIDDEN), draw(HIDDEN, CLASSES), zero(CLASSES), draw(CLASSES, HIDDEN, CLASSES), zero(CLASSES, CLASSES))

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def load(self, flat: np.ndarray) -> WindowNetwork:
        out, at = [], 0
        for a in self.arrays():
            out.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32).copy())
            at += a.size
        return WindowNetwork(*out)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.embed[0][context[0]]
        for place in range(1, len(context)):
            total += self.embed[place][context[place]]
        total += self.bias
        return np.tanh(total, out=total)

    def _steps(self, hidden: np.ndarray, target: np.ndarray):
        """Probabilities of classes, of words in the target's class, and each class's rows."""
        cls, word = target // CLASSES, target % CLASSES
        by_class = _softmax(hidden @ self.to_class + self.class_bias)
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        edge = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        by_word = np.empty((len(target), CLASSES), np.float32)
        sorted_hidden = hidden[order]
        for c in range(CLASSES):
            a, b = edge[c], edge[c + 1]
            if b > a:
                by_word[a:b] = sorted_hidden[a:b] @ self.to_word[c] + self.word_bias[c]
        return cls, word, by_class, _softmax(by_word), order, edge, sorted_hidden

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each target word, given the ids at each place around it."""
        cls, word, by_class, by_word, order, _, _ = self._steps(self.hidden(context), target)
        at = np.arange(len(target))
        out = np.log(np.maximum(by_class[at, cls], 1e-12))
        out[order] += np.log(np.maximum(by_word[at, word[order]], 1e-12))
        return out

    def gradients(self, context: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Of the mean negative log-probability, in the order of ``arrays``."""
        n, at = np.float32(len(target)), np.arange(len(target))
        hidden = self.hidden(context)
        cls, word, by_class, by_word, order, edge, sorted_hidden = self._steps(hidden, target)
        by_class[at, cls] -= 1
        by_word[at, word[order]] -= 1
        by_class /= n
        by_word /= n
        to_word, word_bias = np.zeros_like(self.to_word), np.zeros_like(self.word_bias)
        back = np.empty_like(hidden)
        for c in range(CLASSES):
            a, b = edge[c], edge[c + 1]
            if b > a:
                to_word[c] = sorted_hidden[a:b].T @ by_word[a:b]
                word_bias[c] = by_word[a:b].sum(0)
                back[order[a:b]] = by_word[a:b] @ self.to_word[c].T
        back += by_class @ self.to_class.T
        back *= 1 - hidden * hidden
        embed = np.zeros_like(self.embed)
        for place, ids in enumerate(context):
            by_id = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], ids[by_id][1:] != ids[by_id][:-1])))
            embed[place][ids[by_id][first]] = np.add.reduceat(back[by_id], first, axis=0)
        return [embed, back.sum(0), hidden.T @ by_class, by_class.sum(0), to_word, word_bias]

    def learn(self, context: np.ndarray, target: np.ndarray, squares: list[np.ndarray], rate: float) -> None:
        """One step of gradient descent with a rate for each weight (Adagrad)."""
        for weight, gradient, square in zip(self.arrays(), self.gradients(context, target), squares):
            square += gradient * gradient
            weight -= rate * gradient / (np.sqrt(square) + np.float32(1e-6))


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def _windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids at each place around each word of the texts, the words, and each one's text. Texts never mix."""
    gap = np.zeros(REACH, np.uint16)
    line = np.concatenate([gap, *[x for text in texts for x in (text, gap)]])
    size = np.array([len(t) for t in texts])
    start = np.cumsum(size + REACH) - size
    row = np.repeat(np.arange(len(texts)), size)
    at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    places = [p for p in range(-REACH, REACH + 1) if p]
    return np.stack([line[at + p] for p in places]) if len(at) else np.zeros((2 * REACH, 0), np.uint16), line[at], row


def _texts(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint16) if x.is_valid else np.zeros(0, np.uint16) for x in column]


def _averaged(parts: DataFrame, model: WindowNetwork) -> np.ndarray | None:
    """The mean of models by their words, folded by groups of 16 until one group is left."""

    def fold(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("part").to_numpy(), kind="stable")
        words = table.column("words").to_numpy()
        total = np.zeros(model.flat().size)
        for i in order.tolist():
            total += np.frombuffer(table.column("model")[i].as_buffer(), np.float32).astype(np.float64) * words[i]
        mean = (total / max(words.sum(), 1)).astype(np.float32).tobytes()
        part = int(table.column("part").to_numpy().min()) // 16
        return pa.Table.from_arrays([pa.array([part]), pa.array([int(words.sum())]), pa.array([mean], pa.binary())], names=["part", "words", "model"])

    n = parts.count()
    while n > 16:
        parts = parts.groupBy(F.floor(F.col("part") / 16)).applyInArrow(fold, "part bigint, words bigint, model binary")
        n = -(-n // 16)
    rows = parts.toArrow()
    return np.frombuffer(fold(rows).column("model")[0].as_buffer(), np.float32) if rows.num_rows else None


def train(corpus: DataFrame, scratch: Scratch, rounds: int = ROUNDS, share: int = SHARE_WORDS, rate: float = RATE) -> WindowNetwork:
    """Train on every document of (_row, words, ids) once: each round takes its part of them, by hash of the row.

    The corpus is dealt anew by hash first, so that each task sees a mixture of sources.
    """
    spark, model = corpus.sparkSession, WindowNetwork.fresh()
    total = corpus.agg(F.sum("words")).first()[0] or 0
    tasks = max(1, -(-total // share))
    turn = F.pmod(F.xxhash64("_row", F.lit("turn")), F.lit(rounds)).alias("turn")
    dealt = corpus.select("_row", "ids", turn, F.pmod(F.xxhash64("_row"), F.lit(tasks)).alias("part"))
    dealt = scratch.keep(dealt.repartition(tasks, "part").sortWithinPartitions("part", "_row"), "dealt")
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def learn(table: pa.Table) -> pa.Table:
            own = shared.value.load(shared.value.flat())
            squares = [np.full_like(a, 1e-4) for a in own.arrays()]
            rng, held, words, size = np.random.default_rng(k), [], 0, 0

            def step():
                context, target, _ = _windows(held)
                mixed = rng.permutation(len(target))
                for a in range(0, len(mixed), BATCH):
                    at = mixed[a : a + BATCH]
                    own.learn(context[:, at], target[at], squares, rate)

            table = table.sort_by("_row")
            for text in (t for c in table.column("ids").chunks for t in _texts(c)):
                held.append(text)
                words, size = words + len(text), size + len(text)
                if size >= 32 * BATCH:
                    step()
                    held, size = [], 0
            if size:
                step()
            part = table.column("part")[0].as_py()
            return pa.Table.from_arrays(
                [pa.array([part]), pa.array([words]), pa.array([own.flat().tobytes()], pa.binary())], names=["part", "words", "model"]
            )

        own = dealt.where(F.col("turn") == k).groupBy("part").applyInArrow(learn, "part bigint, words bigint, model binary")
        mean = _averaged(scratch.keep(own.where("words > 0"), f"models{k}"), model)
        if mean is not None:
            model = model.load(mean)
    return model


def score_documents(docs: DataFrame, scratch: Scratch, rounds: int = ROUNDS, share: int = SHARE_WORDS, key: str = "doc_id") -> DataFrame:
    """(key, n_words, log_likelihood, per_word): whole documents; higher is likelier.

    Words are runs of bytes outside ASCII white space, lower-cased in ASCII. Null and texts without words have
    no words, a sum of 0 and no mean (null). Repeated rows are learnt from and scored one by one; an empty table gives no rows.
    A very long text is scored in one task, in batches of its words. Other columns are not read, whatever their names.
    """
    frequent = frequent_words(docs, scratch)
    corpus = scratch.keep(with_row(tokenised(docs, frequent, key)), "corpus")
    model = docs.sparkSession.sparkContext.broadcast(train(corpus, scratch, rounds, share))

    def score(batches):
        for batch in batches:
            texts = _texts(batch.column(2))
            sums, a = np.zeros(len(texts)), 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= 16 * BATCH):
                    size, b = size + len(texts[b]), b + 1
                context, target, row = _windows(texts[a:b])
                for i in range(0, len(target), BATCH):
                    part = slice(i, i + BATCH)
                    log_p = model.value.log_probability(context[:, part], target[part])
                    sums[a:b] += np.bincount(row[part], log_p, minlength=b - a)
                a = b
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums)], names=[key, "n_words", "log_likelihood"])

    kind = docs.schema[key].dataType.simpleString()
    scored = arrow_map(corpus.select(key, "words", "ids"), score, f"{key} {kind}, n_words bigint, log_likelihood double")
    return scored.withColumn("per_word", F.try_divide("log_likelihood", "n_words"))
