"""Benchmark decontamination by winnowing.

Every window of 13 words keeps the smallest hash of the 5-word grams in it. Two texts that share
13 consecutive words keep the same hash there, so no shared window is missed. Kept hashes of the
documents pass a bitmap of the benchmark's hashes (fixed size, without false negatives); survivors
are joined with the benchmark on the hash and on the window's words, which extends and proves the hit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tersa.llm.common import Scratch, Words, arrow_map, chunks, list_array, lower_ascii, mix, rows_by_text, text_column, with_row

WINDOW = 13
GRAM = 5
#: Bits of the benchmark's bitmap: half a megabyte is sent to each executor, whatever the benchmark's size.
BITMAP = 1 << 22


def _is_word() -> np.ndarray:
    inside = np.zeros(256, bool)
    inside[48:58] = inside[97:123] = inside[128:] = True
    return inside


def _gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * np.uint64(0x100000001B3) + hashes[j : j + n]
    return mix(total + np.uint64(k))


def _window_hashes(hashes: np.ndarray, words: int, window: int, gram: int) -> np.ndarray:
    """The smallest gram hash of each window; windows under ``window`` words are one gram."""
    if words < window:
        return _gram_hashes(hashes, words)
    grams, size = _gram_hashes(hashes, gram), window - gram + 1
    width = 1
    while width * 2 <= size and len(grams) > width:
        grams, width = np.minimum(grams[:-width], grams[width:]), width * 2
    rest = size - width
    if rest and len(grams) > rest:
        grams = np.minimum(grams[: len(grams) - rest], grams[rest:])
    return grams if len(hashes) >= window else grams[:0]


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BITMAP - 1)).astype(np.int64)


def _find_windows(words: Words, lengths: list[int], bitmap: np.ndarray | None, window: int, gram: int):
    """(first words, lengths, hashes) of the windows, of the short rows' own length without a bitmap."""
    hashes = words.hashes()
    found = []
    for length in lengths:
        kept = _window_hashes(hashes, length, window, gram)
        first = np.arange(len(kept))
        same = words.row[first] == words.row[first + length - 1] if len(kept) else np.zeros(0, bool)
        if bitmap is None:
            if length < window:  # only rows of just so many words
                same &= words.counts[words.row[first]] == length
        else:
            slots = _slots(kept)
            same &= (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
        first = first[same]
        found.append((first, np.full(len(first), length), kept[same]))
    return [np.concatenate(x) for x in zip(*found)]


def _scan(texts: DataFrame, key: str, lengths: list[int], bitmap, window: int, gram: int) -> DataFrame:
    """One row a text: its words and its candidate windows."""
    is_word, fold, slots = _is_word(), lower_ascii(), bitmap

    def scan(batches):
        bits = slots.value if slots is not None else None
        for batch in batches:
            data, offsets = text_column(batch)
            keys = batch.column(batch.schema.get_field_index(key))
            for a, b in chunks(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], is_word, fold)
                first, length, hashes = _find_windows(words, lengths, bits, window, gram)
                row = words.row[first] if len(first) else np.zeros(0, np.int64)
                by_row = np.argsort(row, kind="stable")
                spans = pa.StructArray.from_arrays([
                    pa.array((first - words.first[row])[by_row], pa.int64()),
                    pa.array(length[by_row], pa.int32()),
                    pa.array(hashes[by_row].view(np.int64), pa.int64()),
                    pa.array([words.text(i, i + m).decode() for i, m in zip(first[by_row], length[by_row])], pa.string()),
                ], names=["start", "length", "hash", "words"])
                counts = np.bincount(row, minlength=words.rows)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a), pa.array(words.counts, pa.int64()), list_array(spans, counts)],
                    names=[key, "n_words", "windows"],
                )

    kind = texts.schema[key].dataType.simpleString()
    spans = "array<struct<start: bigint, length: int, hash: bigint, words: string>>"
    return arrow_map(texts.select(key, "text"), scan, f"{key} {kind}, n_words bigint, windows {spans}")


def contamination(
    docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM,
    item: str = "item_id", key: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """(documents, hits). documents: one row a document with key, ``_row``, n_words, n_hit, n_items, items.

    hits: each occurrence (``_row``, start word, length, words, items). Words are runs of bytes outside
    ASCII punctuation, space and control, lower-cased in ASCII. A benchmark text under ``window`` words
    is one window; one without words, or null, gives none. Null and empty documents have no words.
    Rows that repeat are judged one by one; item ids that repeat are one item, a null id is ``''``.
    An empty benchmark contaminates nothing; an empty table gives no rows. A very long text is read in one task. Other columns are
    not read, whatever their names.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("_item"), "text")
    known = _scan(items, "_item", list(range(1, window + 1)), None, window, gram)
    known = scratch.keep(
        known.select("_item", F.explode("windows").alias("w")).select("_item", "w.length", "w.hash", "w.words")
        .groupBy("length", "hash", "words").agg(F.sort_array(F.collect_set("_item")).alias("items")), "windows"
    )
    lengths = sorted(r.length for r in known.select("length").distinct().collect())  # at most ``window``
    bits = np.zeros(BITMAP // 8, np.uint8)
    slots = known.select(F.col("hash").bitwiseAND(F.lit(BITMAP - 1)).alias("s")).distinct().toArrow()
    slots = slots.column("s").to_numpy()  # at most BITMAP
    np.bitwise_or.at(bits, slots >> 3, np.uint8(1) << (slots & 7).astype(np.uint8))
    seen = _scan(docs.select(key, "text"), key, lengths or [window], spark.sparkContext.broadcast(bits), window, gram)
    seen = scratch.keep(with_row(seen), "documents")
    spans = seen.select("_row", F.explode("windows").alias("w")).select("_row", "w.*")
    hits = spans.join(known, ["length", "hash", "words"]).drop("hash")
    before = Window.partitionBy("_row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    covered = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))))
    by_doc = (
        hits.withColumn("covered", covered).groupBy("_row")
        .agg(F.sum("covered").alias("n_hit"), F.collect_set("items").alias("sets"))
        .select("_row", "n_hit", F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items"))
    )
    none = F.array().cast("array<string>")
    out = seen.drop("windows").join(by_doc, "_row", "left").select(
        key, "_row", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"),
    )
    return out, hits


def clean_documents(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, key: str = "doc_id", **options) -> DataFrame:
    """The documents that are not contaminated, with the columns they have.

    Rows are found again by key and text, so rows that repeat a key are judged by their own text.
    """
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    named = docs.select(F.struct(F.col(key).alias("id"), text_hash.alias("text_hash")).alias("_id"), "text")
    judged, _ = contamination(named, benchmark, scratch, key="_id", **options)
    bad = judged.where(contaminated()).select(F.col("_id.id").alias("_key"), F.col("_id.text_hash").alias("_hash")).distinct()
    return rows_by_text(docs, bad, key, "left_anti")


def contaminated(n_hit="n_hit", n_words="n_words"):
    """At least a twentieth of the words is hit."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))
