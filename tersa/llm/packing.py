"""Best-fit packing of token sequences, improved by a swap-based local search.

Bins that hold the same sizes are alike, so a packing is a table of patterns (sizes in a bin) and how
many bins follow each. It depends on the count of each size only: at most ``capacity`` numbers, and a
few thousand patterns, whatever the corpus. Best fit and the local search work on that table, and an
exchange applies to all bins of a pattern at once. Spark counts sizes, numbers the pieces of each size
and gives every piece the bin and place that the table holds for its number.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from array import array
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersa.llm.common import Scratch, arrow_map, gapless, with_row

CAPACITY = 1024
END = 2
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The one special token of the vocabulary (fixed value).
SPECIAL = {"<|endoftext|>": 50256}
#: Words whose ids a worker remembers (some 100 MB); past it, it forgets all and starts anew.
REMEMBERED_WORDS = 300_000
#: Exchanges the local search tries; each takes well under a millisecond.
SEARCH_STEPS = 20_000

_OTHER_SPACE = re.compile(r"[\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]")


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit integers.

    The vocabulary never joins a space to what stands before it, so a text may be cut before a
    single space between two other characters. Words are then encoded once and remembered. Texts
    with any other white space next to a space are encoded whole.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._bpe = tiktoken.Encoding(
            "corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL
        )
        whole = self.whole

        class Remembered(dict):
            def __missing__(self, word):
                ids = whole(" " + word)
                if len(word) <= 64:
                    if len(self) >= REMEMBERED_WORDS:
                        self.clear()
                    self[word] = ids
                return ids

        self._words = Remembered()

    def whole(self, text: str) -> bytes:
        if "<|" in text:
            return array("I", self._bpe.encode(text, allowed_special="all")).tobytes()
        return array("I", self._bpe.encode_ordinary(text)).tobytes()

    def __call__(self, text: str) -> bytes:
        if (
            not text or "  " in text or "\n " in text or " \n" in text or text[0] == " " or text[-1] == " "
            or _OTHER_SPACE.search(text)
        ):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self._words.__getitem__, rest))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(
    docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None,
    keep_ids: bool = False, key: str = "doc_id",
) -> DataFrame:
    """The ids of each text and an end id, in pieces of at most ``capacity``; null is an empty text.

    Only longer documents are cut: into full pieces, after a first one of what is left over. Every row
    gives at least one piece, so repeated rows and ids do too; an empty table gives none. A very long text is encoded in
    one task. Other columns are not read, whatever their names.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    tail = array("I", [end]).tobytes()

    def cut(batches):
        encode = encoder(path)
        for batch in batches:
            keys = batch.column(0)
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                tokens = encode(text or "") + tail
                n = len(tokens) // 4
                view, a, k = memoryview(tokens), 0, 0
                b = n % capacity or capacity
                while a < n:
                    part = view[4 * a : 4 * b]
                    row.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(bytes(part))
                    a, b, k = b, b + capacity, k + 1
            columns = [
                keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return arrow_map(docs.select(key, "text"), cut, schema + ", ids binary" * keep_ids)


def best_fit(sizes: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing over counts of sizes: pattern (sizes, descending) -> bins."""
    open_bins: dict[int, list] = defaultdict(list)  # room -> [pattern, bins]
    for size in sorted(sizes, reverse=True):
        left = sizes[size]
        for room in range(size, capacity):  # the tightest bins first; each takes all that fit
            while left and open_bins[room]:
                pattern, bins = open_bins[room].pop()
                fit = room // size
                full = min(bins, left // fit)
                rest = left - full * fit if full < bins else 0
                if full:
                    open_bins[room - fit * size].append([pattern + (size,) * fit, full])
                if rest:
                    open_bins[room - rest * size].append([pattern + (size,) * rest, 1])
                if bins - full - bool(rest):
                    open_bins[room].append([pattern, bins - full - bool(rest)])
                left -= full * fit + rest
            if not left:
                break
        if left:
            fit = capacity // size
            if left // fit:
                open_bins[capacity - fit * size].append([(size,) * fit, left // fit])
            if left % fit:
                open_bins[capacity - left % fit * size].append([(size,) * (left % fit), 1])
    packed: Counter = Counter()
    for group in open_bins.values():
        for pattern, bins in group:
            packed[pattern] += bins
    return packed


class _Underfull:
    """Patterns with room left, by what could be taken out of one (nothing, an item or two) and its room."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.live = np.zeros((capacity + 1, capacity + 1), np.int32)  # what comes out, room -> patterns
        self.room = np.zeros(capacity + 1, np.int64)  # the largest room by what comes out
        self.at: dict[tuple[int, int], set] = defaultdict(set)

    @staticmethod
    def outs(pattern: tuple) -> set[tuple]:
        return {(), *((x,) for x in pattern), *combinations(pattern, 2)}

    def change(self, pattern: tuple, by: int) -> None:
        room = self.capacity - sum(pattern)
        if not room or not pattern:
            return
        for out in {sum(o) for o in self.outs(pattern)}:
            (self.at[out, room].add if by > 0 else self.at[out, room].discard)(pattern)
            self.live[out, room] += by
            if by > 0:
                self.room[out] = max(self.room[out], room)
            elif self.room[out] == room and not self.live[out, room]:
                rest = np.flatnonzero(self.live[out])
                self.room[out] = rest[-1] if len(rest) else 0

    def target(self, size: int, donor: tuple, fill: int):
        """(pattern, what comes out) that takes ``size`` instead; it fills up, or takes the most it can."""
        out = np.arange(size)
        for exact in (True, False):
            more = size - out
            ok = self.live[out, more] > 0 if exact else self.room[out] >= more
            for y in np.flatnonzero(ok):  # the least comes out first
                room = size - int(y) if exact else int(self.room[y])
                for pattern in self.at[int(y), room]:
                    if pattern != donor and self.capacity - room + size - int(y) > fill:
                        return pattern, int(y)
        return None


def _without(pattern: tuple, out: tuple) -> tuple:
    left = list(pattern)
    for x in out:
        left.remove(x)
    return tuple(left)


def local_search(packed: Counter, capacity: int, steps: int = SEARCH_STEPS) -> Counter:
    """Exchange sizes between underfull bins while the sum of squared fills grows; empty bins go.

    The emptiest pattern gives one item, or two, to a fuller one, for nothing, one or two smaller
    items in return. It ends when no exchange helps, at the least possible number of bins, or
    after ``steps`` exchanges.
    """
    packed = Counter({p: n for p, n in packed.items() if n})
    least = -(-sum(sum(p) * n for p, n in packed.items()) // capacity)
    bins, under = sum(packed.values()), _Underfull(capacity)
    queue = []
    for pattern in packed:
        under.change(pattern, 1)
        if sum(pattern) < capacity:
            queue.append((sum(pattern), pattern))
    heapq.heapify(queue)

    def add(pattern: tuple, n: int) -> None:
        before = packed[pattern]
        packed[pattern] = before + n
        if not packed[pattern]:
            del packed[pattern]
            under.change(pattern, -1)
        elif not before:
            under.change(pattern, 1)
            if sum(pattern) < capacity:
                heapq.heappush(queue, (sum(pattern), pattern))

    while queue and steps and bins > least:
        fill, donor = heapq.heappop(queue)
        if donor not in packed:
            continue
        gives = sorted({*((x,) for x in donor), *combinations(donor, 2)}, key=sum, reverse=True)
        for out in gives:
            if sum(out) > capacity or not (found := under.target(sum(out), donor, fill)):
                continue
            target, back_sum = found
            back = next(o for o in sorted(under.outs(target), key=len) if sum(o) == back_sum)
            n = min(packed[donor], packed[target])
            add(donor, -n), add(target, -n)
            add(tuple(sorted(_without(target, back) + out, reverse=True)), n)
            rest = tuple(sorted(_without(donor, out) + back, reverse=True))
            if rest:
                add(rest, n)
            else:
                bins -= n
            if donor in packed:
                heapq.heappush(queue, (fill, donor))
            steps -= 1
            break
    return packed


def plan(sizes: dict[int, int], capacity: int = CAPACITY, steps: int = SEARCH_STEPS) -> np.ndarray:
    """Rows (size, first number, sequence of that number, offset), sorted: where the pieces of a size go."""
    rows, used, sequence = [], Counter(), 0
    for pattern, bins in sorted(local_search(best_fit(sizes, capacity), capacity, steps).items(), reverse=True):
        offset = 0
        for size in pattern:
            rows.append((size, used[size], sequence, offset))
            used[size] += bins
            offset += size
        sequence += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY, size: str = "length") -> DataFrame:
    """Adds sequence_id and offset: sequences of at most ``capacity``, gapless from 0, as few as found.

    Sizes must lie between 1 and ``capacity``. Equal sizes take their places in the order of a row
    number, so repeated rows are packed one by one; an empty table stays empty. Other columns are kept.
    """
    numbered = scratch.keep(with_row(pieces, "_piece"), "pieces")
    counts = {r[0]: r[1] for r in numbered.groupBy(size).count().collect()}  # at most ``capacity`` rows
    table = plan(counts, capacity)
    shared = pieces.sparkSession.sparkContext.broadcast(table)
    ranked = gapless(numbered, sum(counts.values()), ["_piece"], [size], "_rank").drop("_piece")
    names, kinds = pieces.columns, [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema]

    def place(batches):
        rows = shared.value
        keys = (rows[:, 0] << 44) + rows[:, 1]
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index(size)).to_numpy()
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy()
            at = np.searchsorted(keys, (sizes << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(rows[at, 2] + rank - rows[at, 1]), pa.array(rows[at, 3])],
                names=[*names, "sequence_id", "offset"],
            )

    return arrow_map(ranked.select(*names, "_rank"), place, ", ".join([*kinds, "sequence_id bigint", "offset bigint"]))
