"""Suffix array of byte strings with common prefixes, by external induced sorting.

Suffixes that begin a descent (S*, smaller than what precedes them) are sorted first: their substrings up
to the next S* are named in order, and the string of names is sorted by the same kind of names, doubled,
until they differ or span ``DEPTH`` bytes. All other suffixes are induced: an ascending scan hands each
L-type predecessor to the queue of its first byte, a descending scan each S-type one. A queue holds (position,
common prefix with the entry before) and yields them in order, so the queues together are a priority queue.
It keeps at most ``memory`` bytes and spills the rest to a file that ends with the task. Scans work on whole
batches; the common prefix of two induced suffixes is one more than the least one scanned between.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Common prefixes are exact up to here; longer ones count as this or more.
DEPTH = 50
BATCH = 1 << 18
_NONE = np.uint8(255)


class DiskQueues:
    """First-in-first-out queues of (position, common prefix) by byte, spilled to one unlinked file."""

    def __init__(self, memory: int):
        self.memory, self.held, self.file = memory, 0, None
        self.chunks: list[list] = [[] for _ in range(256)]

    def put(self, symbol: int, position: np.ndarray, prefix: np.ndarray) -> None:
        if len(position):
            self.chunks[symbol].append((position, prefix))
            self.held += position.nbytes + prefix.nbytes
            if self.held > self.memory:
                self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for chunks in self.chunks:
            for i, chunk in enumerate(chunks):
                if isinstance(chunk[0], np.ndarray):
                    at = self.file.seek(0, 2)
                    self.file.write(chunk[0].tobytes() + chunk[1].tobytes())
                    chunks[i] = (at, len(chunk[0]))
        self.held = 0

    def _load(self, chunk) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(chunk[0], np.ndarray):
            self.held -= chunk[0].nbytes + chunk[1].nbytes
            return chunk
        at, n = chunk
        self.file.seek(at)
        return np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(n), np.uint8)

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """What waits, up to a batch, in the order it came."""
        got, size = [], 0
        chunks = self.chunks[symbol]
        while len(got) < len(chunks) and size < BATCH:
            got.append(self._load(chunks[len(got)]))
            size += len(got[-1][0])
        del chunks[: len(got)]
        if not got:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        return np.concatenate([p for p, _ in got]), np.concatenate([c for _, c in got])

    def backwards(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All chunks, the last one first; each still in its order."""
        while self.chunks[symbol]:
            yield self._load(self.chunks[symbol].pop())


class _RangeMin:
    """Least of any range of a byte array, from minima over powers of two."""

    def __init__(self, values: np.ndarray):
        levels, self.starts, at = [values], [0], len(values)
        while len(levels[-1]) > 1 << (len(levels) - 1):
            step = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
            self.starts.append(at)
            at += len(levels[-1])
        self.flat, self.starts = np.concatenate(levels), np.array(self.starts)

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Over first..last, both included; 255 where that is empty."""
        n = last - first + 1
        level = np.maximum(np.frexp(n.astype(np.float64))[1] - 1, 0)
        start = self.starts[level]
        left = self.flat[np.minimum(start + first, len(self.flat) - 1)]
        right = self.flat[start + last - (1 << level) + 1]
        return np.where(n > 0, np.minimum(left, right), _NONE)


def words_at(text: np.ndarray, position: np.ndarray, step: int) -> np.ndarray:
    """Eight bytes from position + 8 * step as a number that orders like them; text is padded."""
    view = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))
    return view[np.minimum(position + 8 * step, len(view) - 1)].astype(np.uint64)


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix of suffixes a and b, at most ``DEPTH``."""
    out, open_ = np.full(len(a), DEPTH, np.uint8), np.arange(len(a))
    for step in range(-(-DEPTH // 8)):
        x = words_at(text, a[open_], step) ^ words_at(text, b[open_], step)
        differ = x != 0
        top = np.frexp((x[differ] >> np.uint64(11)).astype(np.float64))[1] + 11
        top = np.where(x[differ] >> np.uint64(11) == 0, np.frexp(x[differ].astype(np.float64))[1], top)
        out[open_[differ]] = np.minimum(8 * step + (64 - top) // 8, DEPTH)
        open_ = open_[~differ]
    return out


def _refine(rank: np.ndarray, key: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Split equal ranks by key; a rank is the place of its group's first member. Returns who is still tied."""
    place = np.argsort(key)
    r = rank[among]
    if len(r) and (r[0] != r).any():  # ranks and keys in order as one number: a string is shorter than 2 ** 32
        k = key[place]
        dense = np.empty(len(key), np.uint64)
        dense[place] = np.cumsum(np.concatenate(([False], k[1:] != k[:-1])))
        place = np.argsort(r.astype(np.uint64) << np.uint64(32) | dense)
    order, k, r = among[place], key[place], r[place]
    new_group = np.concatenate(([True], r[1:] != r[:-1]))
    new_part = new_group | np.concatenate(([True], k[1:] != k[:-1]))
    at = np.arange(len(order))
    group_start = np.maximum.accumulate(np.where(new_group, at, 0))
    part_start = np.maximum.accumulate(np.where(new_part, at, 0))
    rank[order] = r + part_start - group_start
    size = np.diff(np.append(np.flatnonzero(new_part), len(order)))
    return np.sort(order[np.repeat(size > 1, size)])


def _sort_descents(text: np.ndarray, star: np.ndarray) -> np.ndarray:
    """S* positions in the order of their suffixes, as far as ``DEPTH`` bytes tell them apart."""
    m = len(star)
    length = np.append(np.diff(star) + 1, 1)
    rank, open_, step = np.zeros(m, np.int64), np.ones(m, bool), 0
    part = np.arange(m)
    while len(part):  # names, by eight bytes at a time; groups in which none goes on are left as they are
        word, left = words_at(text, star[part], step), length[part] - 8 * step
        past = np.clip(8 * (8 - left), 0, 63).astype(np.uint64)
        word = np.where(left < 8, word | ((np.uint64(1) << past) - np.uint64(1)), word)
        word = np.where(left <= 0, ~np.uint64(0), word)  # a name that ends is larger than one that goes on
        open_[part] = False
        open_[_refine(rank, word, part)] = True
        step += 1
        tied = np.flatnonzero(open_)
        longer = np.zeros(m, bool)
        longer[rank[tied[length[tied] > 8 * step]]] = True
        part = tied[longer[rank[tied]]]
    tied, span = np.flatnonzero(open_), 1
    while len(tied):  # the string of names, doubled, until the names span the depth
        after = np.minimum(tied + span, m)
        covered = np.append(star, star[-1:] + DEPTH)[after] - star[tied] if m else after
        tied = tied[covered < DEPTH]
        after = tied + span
        tied = _refine(rank, np.where(after < m, rank[np.minimum(after, m - 1)], -1), tied)
        span *= 2
    return star[np.argsort(rank, kind="stable")]


def _descending(text: np.ndarray, n: int) -> np.ndarray:
    """True where a suffix is larger than the next one (L); the last one, the end mark, is not."""
    differ = np.flatnonzero(text[: n - 1] != text[1:n])
    larger = np.zeros(n, bool)
    if len(differ):
        falls = text[differ] > text[differ + 1]
        larger[: differ[-1] + 1] = np.repeat(falls, np.diff(differ, prepend=-1))
    return larger


class _Scan:
    """Takes suffixes in order and hands their predecessors of one type to the queues."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queues: DiskQueues):
        self.text, self.wanted, self.queues = text, wanted, queues
        self.least = np.full(256, _NONE)  # of the common prefixes since a queue's last entry
        self.used = np.zeros(256, bool)

    def batch(self, position: np.ndarray, prefix: np.ndarray) -> None:
        for a in range(0, len(position), BATCH):
            self._batch(position[a : a + BATCH], prefix[a : a + BATCH])

    def _batch(self, position: np.ndarray, prefix: np.ndarray) -> None:
        least, m = _RangeMin(prefix), len(position)
        before = np.maximum(position - 1, 0)
        giving = np.flatnonzero((position > 0) & self.wanted[before])
        symbol = self.text[before[giving]]
        order = np.argsort(symbol, kind="stable")
        at, symbol = giving[order], symbol[order]
        first = np.concatenate(([True], symbol[1:] != symbol[:-1])) if len(at) else np.zeros(0, bool)
        since = np.concatenate(([-1], at[:-1])) + 1 if len(at) else at
        since[first] = 0
        shared = least(since, at)
        shared[first] = np.minimum(shared[first], self.least[symbol[first]])
        induced = np.minimum(shared, DEPTH) + np.uint8(1)
        induced = np.minimum(induced, DEPTH).astype(np.uint8)
        fresh = first & ~self.used[symbol]
        induced[fresh] = 0
        self.least = np.minimum(self.least, prefix.min())
        edges = np.flatnonzero(first).tolist() + [len(at)]
        given = before[at]
        for a, b in zip(edges, edges[1:]):
            self.queues.put(int(symbol[a]), given[a:b], induced[a:b])
        if len(at):
            last = np.append(np.flatnonzero(first)[1:], len(at)) - 1
            self.least[symbol[last]] = least(at[last] + 1, np.full(len(last), m - 1))
            self.used[symbol[last]] = True


def sorted_suffixes(text: np.ndarray, memory: int = 256 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields, byte by byte from the largest, all suffixes that begin with it, in descending order.

    ``text``: symbols below 255 that end with the mark 0; every 0 ends a string. Each entry is (positions,
    common prefix of each with the one before in that order). Prefixes are exact up to ``DEPTH``; suffixes
    that agree so far are in any order. Suffixes that begin with the mark are left out.
    """
    n = len(text)
    padded = np.concatenate((text, np.full(8 * (DEPTH // 8 + 3), 255, np.uint8)))
    larger = _descending(text, n)
    star = np.flatnonzero(~larger[1:] & larger[:-1]) + 1
    star = _sort_descents(padded, star)
    star_prefix = np.zeros(len(star), np.uint8)
    star_prefix[1:] = common_prefix(padded, star[:-1], star[1:])
    star_from = np.searchsorted(text[star], np.arange(257))

    # ascending: L-type suffixes
    queues, kept = DiskQueues(memory // 2), DiskQueues(memory // 2)
    scan = _Scan(text, larger, queues)
    last_large = np.full(256, -1)
    for symbol in range(256):
        while True:
            position, prefix = queues.take(symbol)
            if not len(position):
                break
            last_large[symbol] = position[-1]
            kept.put(symbol, position, prefix)
            scan.batch(position, prefix)
        a, b = star_from[symbol], star_from[symbol + 1]
        if b > a:
            prefix = star_prefix[a:b].copy()
            large = last_large[symbol]
            prefix[0] = common_prefix(padded, np.array([large]), star[a : a + 1])[0] if large >= 0 else 0
            scan.batch(star[a:b], prefix)

    # descending: S-type suffixes, then the L-type ones of the same byte
    queues = DiskQueues(memory // 2)
    scan = _Scan(text, ~larger, queues)
    for symbol in range(255, 0, -1):
        previous = -1
        while True:
            position, prefix = queues.take(symbol)
            if not len(position):
                break
            previous = position[-1]
            scan.batch(position, prefix)
            yield position, prefix
        above = None  # the common prefix of what comes next with the entry before it
        for position, prefix in kept.backwards(symbol):
            down, down_prefix = position[::-1], np.empty_like(prefix)
            down_prefix[1:] = prefix[:0:-1]
            if above is not None:
                down_prefix[0] = above
            elif previous >= 0:
                down_prefix[0] = common_prefix(padded, np.array([previous]), down[:1])[0]
            else:
                down_prefix[0] = 0
            above = prefix[0]
            scan.batch(down, down_prefix)
            yield down, down_prefix
