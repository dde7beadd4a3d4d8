"""Exact substring deduplication on sharded suffix arrays.

Every 50-byte string goes to the shard of the least 16-gram hash in it, so equal strings meet, whatever
document they are in. Neighbouring strings of a document with one least hash travel together, as one
segment. First hashes alone are compared: a string reaches 17 bytes or more from its least gram to the left or
to the right, so segments of which neither side's 33 bytes are in another document cannot repeat. Of the
others a chunk of documents sends each distinct segment once, with the smallest and largest document that
holds it, so text that a third of all documents share is one segment a chunk. A shard sorts the suffixes of
its segments (``induced_sort``), takes the smallest document of each run of suffixes that agree in 50 bytes,
and replies to the chunks where that removes anything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tersa.llm.common import Scratch, arrow_map, chunk_rows, mix, read_chunk, slices, text_column, with_row
from tersa.llm.induced_sort import DEPTH, sorted_suffixes

GRAM = 16
#: Bytes that a string has at least on one side of its least gram, and the length of both.
REACH = (DEPTH - GRAM) // 2
ANCHOR = REACH + GRAM
#: Bytes of an anchor's hash that are sent; a false match only sends a segment that does not repeat.
SHORT = 4
#: Strings of one segment at most; longer runs of one least hash (periodic text) are cut.
SEGMENT = 256
CHUNK = 1 << 20
SHARD_BYTES = 8 << 20
LEAST_SHARDS = 64
#: Memory of a shard's queues before they spill.
QUEUE_BYTES = 64 << 20
_LAST = np.iinfo(np.int64).max


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    n = len(data) - GRAM + 1
    at = lambda k: np.ndarray((n,), "<u8", data, offset=k, strides=(1,))
    x = at(0) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x += at(8) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x165667B19E3779F9)
    x ^= x >> np.uint64(32)
    return x


def _sliding(best: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """The best of each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        values, size = best(values[:-size], values[size:]), size * 2
    return best(values[: size - width], values[width - size :]) if width > size else values


def segment_runs(data: np.ndarray, offsets: np.ndarray):
    """Runs of neighbouring strings with one least hash: (start, number of strings, hash), and the places of
    all least grams with their hashes."""
    none = np.zeros(0, np.int64)
    if len(data) < DEPTH:
        return none, none, none.astype(np.uint64), none, none.astype(np.uint64)
    grams, width = _gram_hashes(np.ascontiguousarray(data)), DEPTH - GRAM + 1
    least = _sliding(np.minimum, grams, width)
    whole = np.ones(len(least), bool)  # strings that end in the document they begin in
    for end in np.unique(offsets[1:-1]).tolist():
        whole[max(end - DEPTH + 1, 0) : end] = False
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(least)))
    start, count = start[whole[start]], count[whole[start]]
    if len(count) and count.max() > SEGMENT:
        parts = -(-count // SEGMENT)
        turn = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, count = np.repeat(start, parts) + turn * SEGMENT, np.minimum(np.repeat(count, parts) - turn * SEGMENT, SEGMENT)
    # a gram is the least of some string if it equals the largest of the least hashes around it
    around = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    around[width - 1 : width - 1 + len(least)] = np.where(whole, least, 0)
    place = np.flatnonzero(grams == _sliding(np.maximum, around, width))
    return start, count, least[start], place, grams[place]


def anchor_hashes(data: np.ndarray, offsets: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the place) of the 33 bytes that end or begin with each least gram inside its document."""
    row = np.searchsorted(offsets, place, side="right") - 1
    view = np.ndarray((max(len(data) - 7, 0),), "<u8", np.ascontiguousarray(data), strides=(1,))
    hashes, index = [], []
    for side, first in ((1, place - REACH), (2, place)):
        own = np.flatnonzero((first >= offsets[row]) & (first + ANCHOR <= offsets[row + 1]))
        at, x = first[own], np.full(len(own), side, np.uint64)
        for step in (0, 8, 16, ANCHOR - 8):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + view[at + step])
        hashes.append(x)
        index.append(own)
    return np.concatenate(hashes), np.concatenate(index)


def _content_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice: eight bytes at a time, the last ones overlapping. Slices are 50 bytes or more."""
    view = np.ndarray((max(len(data) - 7, 0),), "<u8", np.ascontiguousarray(data), strides=(1,))
    out, open_ = mix(length.astype(np.uint64)), np.arange(len(start))
    for step in range(int(length.max(initial=0)) // 8 + 1):
        open_ = open_[length[open_] > 8 * step]
        where = start[open_] + np.minimum(8 * step, length[open_] - 8)
        out[open_] = mix(out[open_] * np.uint64(0x9E3779B97F4A7C15) + view[where])
    return out


class Hashes:
    """The distinct hashes of a chunk, by shard, and which of them several of its documents have."""

    def __init__(self, hashes: np.ndarray, doc: np.ndarray, shards: int):
        self.values, of = np.unique(hashes, return_inverse=True)
        shard = self.values % np.uint64(shards)
        self.order = np.argsort(shard, kind="stable")
        self.edges = np.searchsorted(shard[self.order], np.arange(shards + 1).astype(np.uint64))
        by_hash = np.argsort(of, kind="stable")
        first = np.searchsorted(of[by_hash], np.arange(len(self.values)))
        docs = doc[by_hash]
        self.several = np.zeros(len(self.values), bool)
        if len(first):
            self.several = np.minimum.reduceat(docs, first) < np.maximum.reduceat(docs, first)
        self.of = of


def _doc_numbers(column: pa.Array) -> np.ndarray:
    """Documents without an id come after all others."""
    return column.cast(pa.int64()).fill_null(int(_LAST)).to_numpy(zero_copy_only=False)


class Chunk:
    """A chunk's text, runs and anchors."""

    def __init__(self, payload, key: str, shards: int):
        rows = read_chunk(payload.as_buffer())
        self.data, offsets = text_column(rows)
        doc = _doc_numbers(rows.column(rows.schema.get_field_index(key)))
        self.start, self.count, self.hashes, self.place, self.grams = segment_runs(self.data, offsets)
        anchors, self.anchored = anchor_hashes(self.data, offsets, self.place)
        of = lambda at: doc[np.searchsorted(offsets, at, side="right") - 1]
        self.doc = of(self.start)
        self.anchors = Hashes(anchors, of(self.place[self.anchored]), shards)

    def shared_runs(self, shared: np.ndarray) -> np.ndarray:
        """The runs of which a least gram has an anchor that another document has too."""
        found = (self.anchors.several | shared)[self.anchors.of]
        place = np.unique(self.anchored[found])
        at, gram = self.place[place], self.grams[place]
        wanted = np.zeros(len(self.start), bool)
        run = np.maximum(np.searchsorted(self.start, at - (DEPTH - GRAM), side="right") - 1, 0)
        while len(run):  # the few runs whose strings reach over the gram
            hit = (self.hashes[run] == gram) & (self.start[run] + self.count[run] > at - (DEPTH - GRAM)) & (self.start[run] <= at)
            wanted[run[hit]] = True
            more = (run + 1 < len(self.start)) & (self.start[np.minimum(run + 1, len(self.start) - 1)] <= at)
            run, at, gram = run[more] + 1, at[more], gram[more]
        return np.flatnonzero(wanted)


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 * len(kinds), []
    for kind, n in zip(kinds, np.frombuffer(raw, np.int64, len(kinds))):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def _send_hashes(batches, key: str, shards: int):
    """Each chunk's anchors, some bytes of their hashes, to their shards."""
    for batch in batches:
        for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = Chunk(payload, key, shards).anchors
            short = (own.values[own.order] >> np.uint64(64 - 8 * SHORT)).view(np.uint8).reshape(-1, 8)[:, :SHORT]
            used = np.flatnonzero(np.diff(own.edges))
            blobs = [short[own.edges[k] : own.edges[k + 1]].tobytes() for k in used]
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int64()), pa.array([chunk] * len(used), pa.int64()), pa.array(blobs, pa.binary())],
                names=["shard", "chunk", "hashes"],
            )


def _shared_hashes(table: pa.Table) -> pa.Table:
    """One shard: which of each chunk's hashes another chunk has too, as bits."""
    blobs = [b.as_py() for b in table.column("hashes")]
    wide = np.zeros((sum(map(len, blobs)) // SHORT, 8), np.uint8)
    wide[:, :SHORT] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, SHORT)
    values = wide.view(np.uint64).ravel()
    order = np.argsort(values)
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = values[order][1:] == values[order][:-1]
    shared = np.zeros(len(order), bool)
    shared[order] = same[1:] | same[:-1]
    ends = np.cumsum([len(b) // SHORT for b in blobs])
    bits = [np.packbits(x).tobytes() for x in np.split(shared, ends[:-1])]
    return pa.Table.from_arrays([table.column("chunk"), table.column("shard"), pa.array(bits, pa.binary())], names=["chunk", "shard", "bits"])


def _send_segments(left: pa.Table, right: pa.Table, key: str, shards: int) -> pa.Table:
    """One chunk: its runs that may repeat (for itself, shard -1), and their distinct segments by shard."""
    own = Chunk(left.column("payload")[0], key, shards)
    data, anchors = own.data, own.anchors
    shared = np.zeros(len(anchors.values), bool)
    for shard, bits in zip(right.column("shard").to_pylist(), right.column("bits")):
        a, b = anchors.edges[shard], anchors.edges[shard + 1]
        shared[anchors.order[a:b]] = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=b - a).astype(bool)
    run = own.shared_runs(shared)
    start, count, hashes, doc = own.start[run], own.count[run], mix(own.hashes[run]), own.doc[run]
    length = count + DEPTH - 1
    name = mix(hashes ^ mix(_content_hashes(data, start, length)))
    shard = (hashes % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((name, shard))
    new = np.ones(len(order), bool)
    new[1:] = name[order][1:] != name[order][:-1]
    first = np.flatnonzero(new)
    pick, distinct = order[first], np.empty(len(order), np.int64)
    distinct[order] = np.cumsum(new) - 1
    low = np.minimum.reduceat(doc[order], first) if len(first) else doc
    high = np.maximum.reduceat(doc[order], first) if len(first) else doc
    edges = np.searchsorted(shard[pick], np.arange(shards + 1))
    docs, places = np.unique(np.concatenate((low, high)), return_inverse=True)  # few documents: two or four bytes each
    places = places.astype(np.uint16 if len(docs) < 1 << 16 else np.uint32).reshape(2, -1)
    chunk = left.column("chunk")[0].as_py()
    out = [(-1, _pack(start.astype(np.int64), count.astype(np.int16), distinct.astype(np.int32), edges))]
    for k in np.flatnonzero(np.diff(edges)).tolist():
        part = pick[edges[k] : edges[k + 1]]
        content = data[slices(start[part], length[part])]
        used, place = np.unique(places[:, edges[k] : edges[k + 1]], return_inverse=True)
        out.append((k, _pack(length[part].astype(np.int16), docs[used], place.astype(np.int32).ravel(), content)))
    kinds = [pa.int64(), pa.int64(), pa.binary()]
    columns = [[k for k, _ in out], [chunk] * len(out), [b for _, b in out]]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["shard", "chunk", "segments"])


def _smallest_holders(content: np.ndarray, start: np.ndarray, length: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the segments, laid out one after the other with a mark behind each: the smallest
    document of the segments that hold the 50 bytes from there. Returns that and where each segment begins."""
    begin = np.concatenate(([0], np.cumsum(length + 1)))
    used = np.zeros(256, bool)
    text = np.zeros(begin[-1], np.uint8)
    source = content[slices(start, length)]
    used[source] = True
    symbol = np.cumsum(used).astype(np.uint8)  # UTF-8 leaves 13 byte values unused
    text[slices(begin[:-1], length)] = symbol[source]
    holder = np.repeat(doc, length + 1)
    lowest = np.full(len(text), _LAST)

    def close(position, prefix):
        if len(position):
            edge = np.concatenate(([0], np.flatnonzero(prefix[1:] < DEPTH) + 1))
            low = np.minimum.reduceat(holder[position], edge)
            lowest[position] = np.repeat(low, np.diff(np.append(edge, len(position))))

    carried = (np.zeros(0, np.int64), np.zeros(0, np.uint8))
    for batch in sorted_suffixes(text, QUEUE_BYTES):
        position, prefix = (np.concatenate(x) for x in zip(carried, batch))
        edges = np.flatnonzero(prefix < DEPTH)
        last = edges[-1] if len(edges) else 0  # the last run may go on
        close(position[:last], prefix[:last])
        carried = position[last:], prefix[last:]
    close(*carried)
    return lowest, begin[:-1]


def _answer(table: pa.Table) -> pa.Table:
    """One shard: replies to its chunks."""
    schema = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("reply", pa.binary())])
    parts = [_unpack(b.as_buffer(), np.int16, np.int64, np.int32, np.uint8) for b in table.column("segments")]
    sizes = [len(p[0]) for p in parts]
    low = np.concatenate([docs[place[: len(place) // 2]] for _, docs, place, _ in parts])
    high = np.concatenate([docs[place[len(place) // 2 :]] for _, docs, place, _ in parts])
    length = np.concatenate([p[0] for p in parts]).astype(np.int64)
    content = np.concatenate([p[3] for p in parts])
    del parts
    start = np.cumsum(length) - length
    _, one, same = np.unique(mix(_content_hashes(content, start, length)), return_index=True, return_inverse=True)
    least = np.full(len(one), _LAST)
    np.minimum.at(least, same, low)
    lowest, begin = _smallest_holders(content, start[one], length[one], least)
    del content
    strings = length - DEPTH + 1
    where = slices(begin[same], strings)
    found = lowest[where]
    edge = np.cumsum(strings) - strings
    removing = np.minimum.reduceat(found, edge) < high
    chunk_edge = np.cumsum([0, *sizes])
    out = []
    shard = table.column("shard")[0].as_py()
    for k, chunk in enumerate(table.column("chunk").to_pylist()):
        a, b = chunk_edge[k], chunk_edge[k + 1]
        keep = np.flatnonzero(removing[a:b]) + a
        if len(keep):
            values = found[slices(edge[keep], strings[keep])]
            index = keep - a
            out.append((chunk, shard, _pack(index.astype(np.int32), values)))
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema) if out else schema.empty_table()


def _whole_characters(data: np.ndarray, removed: np.ndarray) -> np.ndarray:
    """Only characters of which every byte is removed."""
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(begin) or begin[0]:
        begin = np.concatenate(([0], begin))
    every = np.minimum.reduceat(removed, begin) if len(data) else removed
    return np.repeat(every, np.diff(np.append(begin, len(data)))) if len(data) else removed


def remove_repeats(docs: DataFrame, scratch: Scratch, whole_characters: bool = False, key: str = "doc_id") -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, kept): one row a document; ``doc`` is its row, ``kept`` the bytes that stay.

    A byte goes if a 50-byte string covers it that also starts in a document with a smaller key, judged on
    the input. Documents with one key do not remove each other; a null key comes after all others. Null text is
    empty; an empty table gives no rows. A very long text is a chunk of its own, whose segments tasks share. Other columns are kept in
    ``doc``, whatever their names. ``whole_characters`` keeps characters of which only some bytes are covered, so that ``kept`` is UTF-8.
    """
    spark = docs.sparkSession
    table = scratch.keep(with_row(chunk_rows(docs, CHUNK), "chunk").select("chunk", "payload", "n_bytes"), "chunks")
    total = table.agg(F.sum("n_bytes")).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-total // SHARD_BYTES))
    packed = table.select("chunk", "payload")
    hashes = arrow_map(
        packed, lambda it: _send_hashes(it, key, shards), "shard bigint, chunk bigint, hashes binary", rows=8
    )
    shared = hashes.groupBy("shard").applyInArrow(_shared_hashes, "chunk bigint, shard bigint, bits binary")
    shared = scratch.keep(shared, "shared")
    sent = packed.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(
        lambda left, right: _send_segments(left, right, key, shards), "shard bigint, chunk bigint, segments binary"
    )
    sent = scratch.keep(sent, "segments")
    replies = sent.where("shard >= 0").groupBy("shard").applyInArrow(_answer, "chunk bigint, shard bigint, reply binary")
    own_runs = sent.where("shard < 0").select("chunk", "shard", F.col("segments").alias("reply"))
    replies = scratch.keep(replies.union(own_runs), "replies")
    schema = T.StructType([
        T.StructField("doc", docs.schema), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")],
        T.StructField("kept", T.BinaryType()),
    ])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = read_chunk(left.column("payload")[0].as_buffer())
        data, offsets = text_column(rows)
        doc = _doc_numbers(rows.column(rows.schema.get_field_index(key)))
        told = dict(zip(right.column("shard").to_pylist(), right.column("reply")))
        start, count, distinct, shard_first = _unpack(told.pop(-1).as_buffer(), np.int64, np.int16, np.int32, np.int64)
        count = count.astype(np.int64)
        strings = np.zeros(int(shard_first[-1]), np.int64)
        strings[distinct] = count
        begin = np.cumsum(strings) - strings
        lowest = np.full(int(strings.sum()), _LAST)
        for shard, reply in told.items():
            index, values = _unpack(reply.as_buffer(), np.int32, np.int64)
            which = shard_first[shard] + index
            lowest[slices(begin[which], strings[which])] = values
        run_doc = doc[np.searchsorted(offsets, start, side="right") - 1]
        at = slices(start, count)[lowest[slices(begin[distinct], count)] < np.repeat(run_doc, count)]
        edge = np.zeros(len(data) + 1, np.int32)
        edge[at] += 1
        edge[at + DEPTH] -= 1
        removed = np.cumsum(edge[:-1]) > 0
        if whole_characters:
            removed = _whole_characters(data, removed)
        row = np.repeat(np.arange(rows.num_rows), np.diff(offsets))
        fresh = removed.copy()
        fresh[1:] &= ~removed[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        fresh[heads] = removed[heads]
        gone = np.bincount(row[removed], minlength=rows.num_rows)
        left_over = data[~removed].tobytes()
        ends = np.cumsum(np.diff(offsets) - gone)
        kept = [left_over[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        return pa.Table.from_arrays([
            pa.chunked_array([rows.to_struct_array()]), pa.array(np.diff(offsets), pa.int64()), pa.array(gone, pa.int64()),
            pa.array(np.bincount(row[fresh], minlength=rows.num_rows), pa.int64()), pa.array(kept, pa.binary()),
        ], names=["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = packed.groupBy("chunk").cogroup(replies.groupBy("chunk"))
    return joined.applyInArrow(finish, schema)


def without_repeats(docs: DataFrame, scratch: Scratch, key: str = "doc_id") -> DataFrame:
    """The documents, with the columns they have, and repeated passages taken out of ``text``.

    ``n_chars``, where there is one, counts the characters left. A document of which nothing is left stays, empty;
    a null text stays null.
    """
    done = remove_repeats(docs, scratch, True, key)
    text = F.when(F.col("doc.text").isNotNull(), F.decode("kept", "UTF-8"))
    new = {"text": text, "n_chars": F.coalesce(F.length(text), F.lit(0)).cast("long")}
    return done.select([(new[c] if c in new else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
