"""Near-duplicate paragraphs by MinHash banding.

A paragraph is a line. Lines of the same words are one line before anything is compared. A line's MinHash over
five-word shingles is cut into bands, enough of them for the wanted recall at the threshold. Lines that share a
band's key are compared by their exact Jaccard similarity; components of what is similar are the classes, of
which the first paragraph stays.

A passage is a run of words that texts share whatever lines it lies in. It is found by winnowing: of each run of so many
words the part of half its length whose hash is least is the anchor, the same one in every text that has the run.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tersa.llm.common import (
    Scratch, Words, _power_tables, arrow_map, chunk_rows, components, lower_ascii, mix, read_chunk, rows_by_text, slices, text_column, with_row,
)

SHINGLE = 5
THRESHOLD = 0.8
#: Words of the shortest passage: over 50.
PASSAGE = 51
RECALL = 0.995
#: MinHash values of a line at most.
MOST_HASHES = 48
CHUNK = 1 << 20
#: Lines of one key that a task compares; more are cut into blocks, and every pair of blocks is compared.
BLOCK_ROWS = 512
#: The same for whole texts, whose shingles are many.
WHOLE_ROWS = 256


def tune(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the longest bands whose number still finds a pair at the threshold with that recall."""
    for rows in range(12, 0, -1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows <= most or rows == 1:
            return bands, rows
    raise AssertionError


def anchor_words(size: int) -> int:
    """Words of an anchor: what two passages of ``size`` words at least have in common if they are linked."""
    return size // 2 + 1


class Lines:
    """The lines of a chunk that have a shingle: place, words, content hashes and shingle hashes.

    ``whole``: a text is one line, and fewer words than a shingle are one shingle.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, shingle: int, whole: bool = False):
        fold, every = lower_ascii(), np.arange(256)
        lines = Words(data, offsets, (every != 10) | whole, np.arange(256, dtype=np.uint8))
        not_space = np.ones(256, bool)
        not_space[[9, 10, 11, 12, 13, 32]] = False
        words = Words(data, offsets, not_space, fold)
        hashes = words.hashes()
        line = np.searchsorted(lines.starts, words.starts, side="right") - 1
        n = np.bincount(line, minlength=len(lines.starts))
        long = np.flatnonzero(n >= (1 if whole else shingle))
        self.row, self.words = lines.row[long], n[long]
        self.paragraph = (np.arange(len(lines.starts)) - lines.first[lines.row])[long]
        self.first = first = (np.cumsum(n) - n)[long]
        up, self._down = _power_tables(len(hashes) + 1)
        self.content, self._sums = [], []
        for seed in (0, 0x5851F42D4C957F2D):
            sums = np.zeros(len(hashes) + 1, np.uint64)
            np.cumsum(mix(hashes ^ np.uint64(seed)) * up[: len(hashes)], out=sums[1:])
            self._sums.append(sums)
            self.content.append(self.runs(first, self.words, -1))
        m = max(len(hashes) - shingle + 1, 0)
        total = np.zeros(m, np.uint64)
        for j in range(shingle):
            total = total * np.uint64(0x100000001B3) + hashes[j : j + m]
        inside = line[:m] == line[shingle - 1 : shingle - 1 + m]
        self.shingle_count = np.maximum(self.words - shingle + 1, 1)
        self.shingle_first = np.cumsum(self.shingle_count) - self.shingle_count
        self.shingles = np.empty(int(self.shingle_count.sum()), np.uint64)
        short = np.zeros(len(self.shingles), bool)
        short[self.shingle_first[self.words < shingle]] = True
        self.shingles[~short] = mix(total[inside])
        self.shingles[short] = self.content[0][self.words < shingle].view(np.uint64)

    def runs(self, first: np.ndarray, words, which: int = 0) -> np.ndarray:
        """A hash of each run of words of the chunk; which: one of the two."""
        sums = self._sums[which]
        return mix((sums[first + words] - sums[first]) * self._down[first]).view(np.int64)

    def anchors(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line, first word in the line and hash of the runs of half the size that are least in a run of ``size`` words."""
        part = anchor_words(size)
        long = np.flatnonzero(self.words >= size)
        count = self.words[long] - size + 1
        line, first = np.repeat(long, count), slices(self.first[long], count)
        place, least = first, self.runs(first, part)
        for j in range(1, size - part + 1):
            other = self.runs(first + j, part)
            less = other < least
            place, least = np.where(less, first + j, place), np.where(less, other, least)
        new = np.ones(len(line), bool)
        new[1:] = (place[1:] != place[:-1]) | (line[1:] != line[:-1])
        return line[new], (place - self.first[line])[new], least[new]

    def keys(self, bands: int, rows: int) -> np.ndarray:
        """One key for each line and band."""
        out = np.empty((len(self.row), bands), np.int64)
        if not len(self.row):
            return out
        rng = np.random.default_rng(17)
        for band in range(bands):
            key = np.full(len(self.row), band, np.uint64)
            for _ in range(rows):
                a, b = rng.integers(0, 1 << 63, 2, np.uint64)
                least = np.minimum.reduceat((self.shingles ^ b) * (a | np.uint64(1)), self.shingle_first)
                key = mix(key + least)
            out[:, band] = key.view(np.int64)
        return out

    def sets(self, index: np.ndarray) -> list[np.ndarray]:
        return [np.unique(self.shingles[a : a + n]) for a, n in zip(self.shingle_first[index], self.shingle_count[index])]


def _lines(table: DataFrame, key: str, kind: str, shingle: int, bands: int, rows: int, whole: bool = False) -> DataFrame:
    """One row a line, with its place in the chunk."""

    def scan(batches):
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs = read_chunk(payload.as_buffer())
                lines = Lines(*text_column(docs), shingle, whole)
                n = len(lines.row)
                keys = lines.keys(bands, rows)
                yield pa.RecordBatch.from_arrays([
                    docs.column(docs.schema.get_field_index(key)).take(pa.array(lines.row)), pa.array(lines.paragraph.astype(np.int32)),
                    pa.array(lines.words), pa.array([chunk] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)),
                    pa.array(lines.content[0]), pa.array(lines.content[1]),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(keys.ravel())),
                ], names=["doc", "paragraph", "n_words", "chunk", "place", "c1", "c2", "keys"])

    schema = f"doc {kind}, paragraph int, n_words bigint, chunk bigint, place int, c1 bigint, c2 bigint, keys array<bigint>"
    return arrow_map(table, scan, schema, rows=8)


def _colliding(batches):
    """Of rows sorted by key, those whose key the row before or after has too."""
    key, line = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = False  # whether the carried row's key has been seen before it

    def out(keep):
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(line[keep])], names=["key", "line"])

    for batch in batches:
        key = np.concatenate((key, batch.column(0).to_numpy()))
        line = np.concatenate((line, batch.column(1).to_numpy()))
        if len(key) > 1:
            same = np.concatenate(([held], key[1:] == key[:-1], [False]))
            keep = same[:-1] | same[1:]
            keep[-1] = False
            yield from out(keep)
            held = bool(same[-2])
            key, line = key[-1:], line[-1:]
    if len(key):
        yield from out(np.array([held]))


def _shared(x, y) -> int:
    """Values that two sets, or two sorted arrays without repeats, have in common."""
    return len(x & y) if isinstance(x, frozenset) else len(np.intersect1d(x, y, assume_unique=True))


def _similar(sets: list, lines: np.ndarray, threshold: float):
    """A spanning forest of the lines whose Jaccard similarity reaches the threshold."""
    rest = list(range(len(lines)))
    while rest:
        front, rest = [rest[0]], rest[1:]
        while front and rest:
            node = front.pop()
            mine, left = sets[node], []
            for other in rest:
                least, most = sorted((len(mine), len(sets[other])))
                shared = _shared(mine, sets[other]) if least >= threshold * most - 1e-9 else 0
                if shared >= threshold * (least + most - shared) - 1e-9:
                    front.append(other)
                    yield lines[node], lines[other]
                else:
                    left.append(other)
            rest = left


def _verify(batches, threshold: float, whole: bool = False):
    """Links inside each group of rows (group, line, shingles) that are sorted by group.

    Shingles of whole texts stay arrays, at a tenth of a set's memory.
    """
    group, line, sets = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def out(end):
        edges = np.flatnonzero(np.concatenate(([True], group[1:end] != group[: end - 1], [True]))) if end else []
        found = [pair for a, b in zip(edges, edges[1:]) if b - a > 1 for pair in _similar(sets[a:b], line[a:b], threshold)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in zip(*found)], names=["a", "b"])

    for batch in batches:
        group = np.concatenate((group, batch.column(0).to_numpy()))
        line = np.concatenate((line, batch.column(1).to_numpy()))
        sets += [x.values.to_numpy().view(np.uint64).copy() for x in batch.column(2)] if whole else map(frozenset, batch.column(2).to_pylist())
        last = int(np.searchsorted(group, group[-1])) if len(group) else 0
        if last:
            yield from out(last)
            group, line, sets = group[last:], line[last:], sets[last:]
    yield from out(len(group))


def _texts(table: DataFrame, key: str, kind: str, size: int) -> DataFrame:
    """One row a text of ``size`` words or more, with the places and hashes of its anchors."""

    def scan(batches):
        for batch in batches:
            for payload in batch.column(0):
                docs = read_chunk(payload.as_buffer())
                texts = Lines(*text_column(docs), size, True)
                text, at, anchor = texts.anchors(size)
                long = np.flatnonzero(texts.words >= size)
                ends = pa.array(np.searchsorted(text, np.append(long, len(texts.row))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    docs.column(docs.schema.get_field_index(key)).take(pa.array(texts.row[long])),
                    pa.array(texts.content[0][long]), pa.array(texts.content[1][long]),
                    pa.ListArray.from_arrays(ends, pa.array(anchor)), pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))),
                ], names=["doc", "c1", "c2", "anchor", "at"])

    schema = f"doc {kind}, c1 bigint, c2 bigint, anchor array<bigint>, at array<int>"
    return arrow_map(table.select("payload"), scan, schema, rows=8)


def _passages(table: DataFrame, scratch: Scratch, key: str, kind: str, size: int) -> DataFrame:
    """(key, first_word, n_words, class_doc, copies, removed): the passages that another row's text holds too.

    ``table`` has the texts in chunks. Texts of the same words are one text before anchors are compared. Anchors that two rows
    hold and that touch make one passage; its class is named by the first row that holds any of them.
    """
    part = anchor_words(size)
    texts = scratch.keep(with_row(_texts(table, key, kind, size), "text"), "texts")
    order = F.struct(F.col("doc").isNull().alias("none"), "doc", "text")
    contents = texts.groupBy("c1", "c2").agg(F.min(order).alias("first"), F.count(F.lit(1)).cast("int").alias("copies"))
    contents = scratch.keep(with_row(contents.orderBy("first"), "rank"), "contents")  # ranks follow the first rows' order
    of = contents.select(F.col("first.text").alias("text"), "rank", "copies")
    anchors = texts.select("text", "anchor", "at").join(of, "text").select("rank", "copies", F.explode(F.arrays_zip("anchor", "at")).alias("one"))
    anchors = anchors.select("rank", "copies", "one.anchor", "one.at")
    by = Window.partitionBy("anchor")
    again = F.lag("rank").over(by.orderBy("rank", "at")).eqNullSafe(F.col("rank"))  # an anchor counts once a text
    held = anchors.withColumn("copies", F.when(again, 0).otherwise(F.col("copies")))
    held = held.select("rank", "at", F.min("rank").over(by).alias("class"), F.sum("copies").over(by).alias("copies")).where("copies > 1")
    along = Window.partitionBy("rank").orderBy("at")
    held = held.withColumn("new", (F.col("at") > F.lag("at").over(along) + part).cast("int"))
    held = held.withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(along))
    found = held.groupBy("rank", "run").agg(
        F.min("at").cast("bigint").alias("first_word"), (F.max("at") - F.min("at") + part).cast("bigint").alias("n_words"),
        F.min("class").alias("class"), F.max("copies").alias("copies"),
    )
    classes = contents.select(F.col("rank").alias("class"), F.col("first").alias("class_first"))
    found = found.join(classes, "class").join(contents.select("rank", "c1", "c2"), "rank")
    found = scratch.keep(found.select("c1", "c2", "first_word", "n_words", "class_first", "copies"), "passages")
    return texts.select("doc", "c1", "c2", "text").join(found, ["c1", "c2"]).select(
        F.col("doc").alias(key), "first_word", "n_words", F.col("class_first.doc").alias("class_doc"), "copies",
        (F.col("text") != F.col("class_first.text")).alias("removed"),
    )


def near_paragraphs(
    docs: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL, key: str = "doc_id",
    whole: bool = False, passage: int | None = None,
) -> DataFrame:
    """(key, paragraph, n_words, class_doc, class_paragraph, copies, removed) for paragraphs that have a near-duplicate.

    ``paragraph`` counts the text's lines that are not empty, from 0. Lines of fewer words than a shingle are left
    alone. The class is named by its first paragraph (smallest key, then place; null keys last), the only one
    that is not removed. Null and empty texts have no paragraphs; repeated rows have repeated paragraphs; an empty table gives no
    rows. A very long text is read in one task. Other columns are not read, whatever their names.
    ``whole``: every text is one paragraph, however short.
    ``passage``: rows follow for passages that texts of two rows share, in whatever lines. Every run of that many words or more is found,
    and of shorter ones those of half as many that an anchor marks. first_word counts the text's words from 0 (null for paragraphs),
    n_words those that anchors cover, paragraph and class_paragraph are null, and copies are the most rows that share an anchor.
    """
    kind = docs.schema[key].dataType.simpleString()
    bands, rows = tune(threshold, recall)
    table = scratch.keep(with_row(chunk_rows(docs.select(key, "text"), CHUNK), "chunk").select("chunk", "payload"), "chunks")
    lines = scratch.keep(with_row(_lines(table, key, kind, shingle, bands, rows, whole), "line"), "lines")
    one = lines.groupBy("c1", "c2").agg(F.min(F.struct("line", "keys")).alias("one"))
    keyed = one.select(F.explode(F.array_distinct("one.keys")).alias("key"), F.col("one.line").alias("line"))
    sorted_keys = keyed.repartition("key").sortWithinPartitions("key", "line")
    members = scratch.keep(arrow_map(sorted_keys, _colliding, "key bigint, line bigint", rows=20_000), "members")

    block = WHOLE_ROWS if whole else BLOCK_ROWS
    hot = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    hot = scratch.keep(hot.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "hot_keys")
    if hot.isEmpty():
        dealt = members.select(F.col("key").alias("group"), "line")
    else:
        own = F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)))).alias("other")
        split = members.join(hot, "key", "left").select("key", "line", own.alias("own"), each)
        pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        dealt = split.select(F.when(F.col("own").isNull(), F.col("key")).otherwise(pair).alias("group"), "line")

    asked = lines.select("line", "chunk", "place").join(members.select("line").distinct(), "line")

    def shingles(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("place").to_numpy()
        sets = Lines(*text_column(read_chunk(left.column("payload")[0].as_buffer())), shingle, whole).sets(place) if len(place) else []
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
        return pa.Table.from_arrays([right.column("line").combine_chunks(), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["line", "shingles"])

    sets = table.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(shingles, "line bigint, shingles array<bigint>")
    sets = scratch.keep(sets, "shingles")
    runs = dealt.join(sets, "line").select("group", "line", "shingles").repartition("group").sortWithinPartitions("group")
    links = arrow_map(runs, lambda it: _verify(it, threshold, whole), "a bigint, b bigint", rows=WHOLE_ROWS if whole else 2000)
    roots = components(scratch.keep(links, "links"), scratch)
    scratch.drop("members", "shingles", "hot_keys", "links")

    same = lines.groupBy("c1", "c2").agg(F.min("line").alias("one"), F.count(F.lit(1)).alias("copies"))
    root = F.coalesce("root", "one")
    rooted = same.join(roots, same["one"] == roots["node"], "left").select("c1", "c2", "copies", root.alias("root"))
    sizes = rooted.groupBy("root").agg(F.sum("copies").alias("copies")).where("copies > 1")
    rooted = scratch.keep(rooted.drop("copies").join(sizes, "root"), "classes")
    slim = lines.select("doc", "paragraph", "n_words", "c1", "c2", "line").join(rooted, ["c1", "c2"])
    order = F.struct(F.col("doc").isNull().alias("none"), "doc", "paragraph", "line")
    first = scratch.keep(slim.groupBy("root").agg(F.min(order).alias("first")), "first")
    found = slim.join(first, "root").select(
        F.col("doc").alias(key), "paragraph", "n_words", F.col("first.doc").alias("class_doc"),
        F.col("first.paragraph").alias("class_paragraph"), "copies", (F.col("line") != F.col("first.line")).alias("removed"),
    )
    if passage:
        found = found.withColumn("first_word", F.lit(None).cast("bigint"))
        found = found.unionByName(_passages(table, scratch, key, kind, passage), allowMissingColumns=True)
    return found


def one_of_each(docs: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, shingle: int = SHINGLE, key: str = "doc_id") -> DataFrame:
    """The documents without near-duplicates: whole texts linked by the exact Jaccard similarity of their shingles.

    Of each class the row with the smallest key stays (null keys last, then by the text's hash), as one row. Texts
    of fewer words than a shingle are linked if their words are equal, and so are texts without words.
    """
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    row = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), text_hash.alias("text_hash"))
    found = near_paragraphs(docs.select(row.alias("row"), "text"), scratch, threshold, shingle, key="row", whole=True)
    found = found.where("removed").select("row", F.col("class_doc").alias("first"))
    blank = docs.where(F.coalesce("text", F.lit("")).rlike("^[\\x09-\\x0D ]*\\z")).groupBy(row.alias("row")).agg(F.count(F.lit(1)).alias("n"))
    least = blank.agg(F.min("row").alias("first"))
    again = blank.join(F.broadcast(least)).where((F.col("row") != F.col("first")) | (F.col("n") > 1)).select("row", "first")
    found = scratch.keep(found.union(again), "removed")
    gone = found.where(F.col("row") != F.col("first")).select(F.col("row.id").alias("_key"), F.col("row.text_hash").alias("_hash")).distinct()
    out = rows_by_text(docs, gone, key, "left_anti")
    if not found.where(F.col("row") == F.col("first")).isEmpty():  # rows that repeat whole
        out = out.dropDuplicates([key, "text"])
    return out
