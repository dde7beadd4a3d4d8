"""SimHash near-duplicates, found by pigeonring filtering.

A fingerprint is cut into distance + 1 segments on a ring. If two fingerprints differ in at most
``distance`` bits, some segment begins a chain whose first l segments differ in at most l - 1 bits, for
every l (budgets in proportion). So a linked pair agrees in that segment and differs in at most one bit of
the next one: both are the join key, the rest of the chain is checked before all 64 bits are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersa.llm.common import Scratch, arrow_map, components, rows_by_text, text_column

DISTANCE = 4
SHINGLE = 4
SEED = 42
#: A key's rows that one task compares; more are cut into blocks, and every pair of blocks is compared.
BLOCK_ROWS = 8192
#: Runs up to this length are compared row by row at every lag.
SHORT_RUN = 16

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of UTF-8 bytes: words by ASCII white space, XXH64 of every shingle."""
    words = raw.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= shingle:
        hashes = digest(joined, SEED)
    else:
        starts = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
        ends = (starts[shingle:] - 1).tolist()
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends)])
    each = np.frombuffer(hashes, np.uint8)
    n = len(each) // 8
    place = (each.reshape(n, 8) + (np.arange(8) << 8)).ravel()
    ones = np.bincount(place, minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * ones > n, axis=1).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: str = "doc_id") -> DataFrame:
    """(key, text_hash, fp): the whole text's fingerprint as a signed long. Null is an empty text; both give 0."""

    def scan(batches):
        for batch in batches:
            data, offsets = text_column(batch)
            values = [fingerprint(data[a:b].tobytes(), shingle) for a, b in zip(offsets[:-1], offsets[1:])]
            fp = pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fp], names=[key, "text_hash", "fp"])

    texts = docs.select(key, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return arrow_map(texts, scan, f"{key} {docs.schema[key].dataType.simpleString()}, text_hash bigint, fp bigint")


def _segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the segments, the first at the top."""
    if not 1 <= distance <= 31:
        raise ValueError("INVALID_PARAMETER: distance must lie between 1 and 31")
    m = distance + 1
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    return [(64 - sum(widths[: i + 1]), w) for i, w in enumerate(widths)]


def _chain_keys(fp: Column, distance: int) -> Column:
    """Hashes of (place, segment, next segment), and of these with each set bit of the next segment cleared.

    If two next segments differ in one bit, clearing it in one gives the other.
    """
    keys, segments = [], _segments(distance)
    for i, (low, width) in enumerate(segments):
        next_low, next_width = segments[(i + 1) % len(segments)]
        part = F.shiftrightunsigned(fp, low).bitwiseAND((1 << width) - 1)
        after = F.shiftrightunsigned(fp, next_low).bitwiseAND((1 << next_width) - 1)
        keys.append(F.array(F.xxhash64(F.lit(i), part, after)))
        keys.append(F.filter(
            F.array(*[
                F.when(after.bitwiseAND(1 << j) != 0, F.xxhash64(F.lit(i), part, after - F.lit(1 << j)))
                for j in range(next_width)
            ]), lambda k: k.isNotNull(),
        ))
    return F.array_distinct(F.concat(*keys))


def _linked(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    """Pairs that stay within the budgets of a chain, then within the distance in all bits."""
    differ = x ^ y
    parts = [np.bitwise_count((differ >> np.uint64(low)) & np.uint64((1 << w) - 1)) for low, w in _segments(distance)]
    m, some = len(parts), np.zeros(len(x), bool)
    for i in range(m):
        total, ok = np.zeros(len(x), np.int64), np.ones(len(x), bool)
        for step in range(m):
            total = total + parts[(i + step) % m]
            ok &= total <= step
        some |= ok
    return some & (np.bitwise_count(differ) <= distance)


def _run_links(group: np.ndarray, fp: np.ndarray, distance: int):
    """Links inside runs of an equal group: all in short runs, a spanning forest of them in long ones."""
    a, b = [], []
    edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    length = np.diff(edge)
    short = np.repeat(length <= SHORT_RUN, length)
    for lag in range(1, min(SHORT_RUN, int(length.max(initial=0)))):
        at = np.flatnonzero((group[lag:] == group[:-lag]) & short[lag:] & (fp[lag:] != fp[:-lag]))
        at = at[_linked(fp[at], fp[at + lag], distance)]
        a.append(fp[at]), b.append(fp[at + lag])
    for i in np.flatnonzero(length > SHORT_RUN):
        rest = np.unique(fp[edge[i] : edge[i + 1]])
        while len(rest):  # one tree after the other
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                node = front.pop()
                near = np.bitwise_count(rest ^ node) <= distance
                found = rest[near]
                a.append(np.full(len(found), node)), b.append(found)
                front.extend(found)
                rest = rest[~near]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(fps: DataFrame, scratch: Scratch, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b) of different fingerprints that connect all within the distance; column ``fp`` is distinct.

    Every link between fingerprints is in the closure of the pairs: a key with few rows gives each of its
    links, one with many a spanning forest, so the number of pairs is bounded by the number of keys.
    """
    keyed = fps.select("fp", F.explode(_chain_keys(F.col("fp"), distance)).alias("key"))
    hot = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK_ROWS)
    hot = scratch.keep(hot.select("key", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")), "hot_keys")
    if hot.isEmpty():
        dealt = keyed.select("fp", F.col("key").alias("group"))
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        split = keyed.join(hot, "key", "left").select(
            "fp", "key", own.alias("own"),
            F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)))).alias("other"),
        )
        pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        dealt = split.select("fp", F.when(F.col("own").isNull(), F.col("key")).otherwise(pair).alias("group"))

    def find(batches):
        group, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            group = np.concatenate((group, batch.column(0).to_numpy()))
            fp = np.concatenate((fp, batch.column(1).to_numpy().view(np.uint64)))
            last = int(np.searchsorted(group, group[-1])) if len(group) else 0
            if last:  # the last run may go on in the next batch
                yield from out(*_run_links(group[:last], fp[:last], distance))
                group, fp = group[last:], fp[last:]
        yield from out(*_run_links(group, fp, distance))

    def out(a, b):
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

    runs = dealt.select("group", "fp").repartition("group").sortWithinPartitions("group")
    return arrow_map(runs, find, "a bigint, b bigint", rows=20_000)


def near_duplicates(
    docs: DataFrame, scratch: Scratch, distance: int = DISTANCE, shingle: int = SHINGLE, key: str = "doc_id",
) -> DataFrame:
    """(key, text_hash, fp, component_id, keeper): every row, and the smallest key its links reach.

    Copies are one fingerprint before any pair is looked for. Rows that repeat, and equal fingerprints,
    are in one component; a null key counts only where a component has no other. ``keeper`` is the
    (key, text_hash) that stays of a component: the smallest, nulls last. Null texts have no words, as empty ones; an empty table
    gives no rows. A very long text is hashed in one task. Other columns are not read, whatever their names.
    """
    marked = scratch.keep(fingerprints(docs, shingle, key), "fingerprints")
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("text_hash")))
    fps = scratch.keep(marked.groupBy("fp").agg(first.alias("first")), "distinct")
    edges = scratch.keep(links(fps.select("fp"), scratch, distance), "links")
    roots = components(edges, scratch)
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left")
    rooted = rooted.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("keeper"))
    known = rooted.join(least, "root").select("fp", F.struct(F.col("keeper.id").alias(key), "keeper.text_hash").alias("keeper"))
    return marked.join(known, "fp").select(
        key, "text_hash", "fp", F.col(f"keeper.{key}").alias("component_id"), "keeper"
    )


def one_of_each(docs: DataFrame, scratch: Scratch, distance: int = DISTANCE, shingle: int = SHINGLE, key: str = "doc_id") -> DataFrame:
    """The documents without near-duplicates: of each component its smallest key stays, as one row, with all its columns.

    Nulls, repeats, empty tables and long texts are as in ``near_duplicates``; other columns may have any names.
    """
    found = scratch.keep(near_duplicates(docs, scratch, distance, shingle, key), "found")
    kept = found.where(F.col(key).eqNullSafe(F.col(f"keeper.{key}")) & (F.col("text_hash") == F.col("keeper.text_hash")))
    kept = kept.groupBy(F.col(key).alias("_key"), F.col("text_hash").alias("_hash")).agg(F.count(F.lit(1)).alias("_n"))
    out = rows_by_text(docs, kept.select("_key", "_hash"), key, "left_semi")
    if not kept.where("_n > 1").isEmpty():  # rows that repeat whole
        out = out.dropDuplicates([key, "text"])
    return out
