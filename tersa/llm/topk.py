"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are dealt to blocks; an index row has a block's vectors and, for every dimension, its rows in order of
that component. A query walks all lists of a block from the end its own component favours, scores what it meets
and stops when not even a vector with the components reached in all lists could beat its k-th best. Each
block yields k rows a query at most; the best of those are the answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tersa.llm.common import Scratch, arrow_map

K = 5
SCALE = 256
BLOCK = 4096
#: Queries that are held next to one block at once.
QUERIES_AT_ONCE = 16384
#: Entries taken from every list at first; each further step doubles it.
FIRST_STEP = 4


def _scaled(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(SCALE * x) of each usable vector, padded by zeros to ``width``; and which are usable."""
    counts = np.asarray(column.value_lengths().fill_null(0), np.int64)
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(counts)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    usable = np.asarray(column.is_valid()) & (bad[ends] == bad[ends - counts])
    scaled = np.floor(SCALE * np.where(np.repeat(usable, counts), values, 0))
    if len(scaled) and np.abs(scaled).max() >= 2.0**62:
        raise ArithmeticError("OVERFLOW: a scaled component does not fit a long")
    dense = np.zeros((len(counts), width), np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    dense[row, np.arange(len(values)) - np.repeat(ends - counts, counts)] = scaled.astype(np.int64)
    return dense[usable], usable


def _index(vectors: DataFrame, width: int, key: str) -> DataFrame:
    """(n, ids, matrix, order): blocks of vectors with each dimension's rows in ascending order."""

    def build(batches):
        for batch in batches:
            dense, usable = _scaled(batch.column(1), width)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[usable].astype(np.int64)
            if len(ids):
                order = np.argsort(dense, axis=0, kind="stable").astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(ids)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, dense, order))],
                    names=["n", "ids", "matrix", "order"],
                )

    kept = vectors.where(F.col(key).isNotNull()).select(key, "embedding")
    return arrow_map(kept, build, "n int, ids binary, matrix binary, order binary", rows=BLOCK)


def threshold_search(
    matrix: np.ndarray, order: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int, skip: int = -1, floats: np.ndarray | None = None,
    largest: float | None = None,
) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows and scores of the k best (ties to the smaller id), and how many rows were scored. ``skip``: no candidate.

    ``floats`` and ``largest``: the matrix as doubles and its largest absolute value, for a caller with many queries.
    """
    n = len(matrix)
    largest = float(np.abs(matrix).max(initial=0)) if largest is None else largest
    used = np.flatnonzero(query)
    up = query[used] > 0
    exact = largest * float(np.abs(query).max(initial=0)) * max(len(query), 1)
    if exact >= 2.0**63:
        raise ArithmeticError("OVERFLOW: a score does not fit a long")
    kind = np.float64 if exact < 2.0**53 else np.int64
    scorable = floats if floats is not None and kind is np.float64 else matrix
    wanted = query.astype(kind)
    seen = np.zeros(n, bool)
    if 0 <= skip < n:
        seen[skip] = True
    best, scores, depth, step, scored = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, FIRST_STEP, 0
    while depth < n:
        to = min(depth + step, n) if 2 * scored < n else n  # most rows are met: the rest is scored without a walk
        fresh = np.zeros(n, bool)
        if to == n or not len(used):
            fresh[:], to = True, n
        else:
            fresh[order[n - to : n - depth, used[up]]] = fresh[order[depth:to, used[~up]]] = True
        fresh = np.flatnonzero(fresh & ~seen)
        seen[fresh] = True
        scored += len(fresh)
        found = (scorable[fresh].astype(kind, copy=False) @ wanted).astype(np.int64)
        best, scores = np.concatenate((best, fresh)), np.concatenate((scores, found))
        if len(scores) > k > 0:  # ties with the k-th best stay
            good = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            best, scores = best[good], scores[good]
        pick = np.lexsort((ids[best], -scores))[:k]
        best, scores = best[pick], scores[pick]
        depth, step = to, step * 2
        reached = np.where(up, order[n - depth, used], order[depth - 1, used])
        bound = int((matrix[reached, used] * query[used]).sum())
        if len(scores) == k and scores[-1] > bound:
            break
    return best, scores, scored


def top_k(vectors: DataFrame, scratch: Scratch, k: int = K, every: int = 50, key: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose key is divisible by ``every``, against all other rows.

    Vectors that are null, or hold a null or non-finite component, and rows without a key take no part. Shorter
    vectors count as padded with zeros. Rows that repeat a key are rows of their own: each is a candidate, and a
    query of its own where the key is divisible. Scores that do not fit a long raise an error. An empty table gives no
    rows; other columns are not read, whatever their names.
    """
    width, total = vectors.agg(F.max(F.size("embedding")), F.count(F.lit(1))).first()
    parts = max(1, -(-total // BLOCK))
    blocks = _index(vectors.select(key, "embedding").repartition(parts), max(width or 0, 0), key)
    width = max(width or 0, 0)
    index = scratch.keep(blocks.withColumn("at", F.monotonically_increasing_id()), "built")
    numbers = index.select("at", (F.row_number().over(Window.orderBy("at")) - 1).alias("block"))  # one row a block
    index = scratch.keep(index.join(numbers, "at").drop("at"), "index")
    scratch.drop("built")
    many = index.count()

    def pick(batches):
        for batch in batches:
            for block, ids, matrix in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                ids = np.frombuffer(ids.as_buffer(), np.int64)
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    rows = np.frombuffer(matrix.as_buffer(), np.int64).reshape(len(ids), width)[at]
                    arrays = [pa.array([x.tobytes()], pa.binary()) for x in (at, ids[at], rows)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block], pa.int64()), pa.array([len(at)], pa.int64()), *arrays], names=["home", "queries", "at", "ids", "rows"]
                    )

    packs = arrow_map(index.select("block", "ids", "matrix"), pick, "home bigint, queries bigint, at binary, ids binary, rows binary", rows=4)
    packs = scratch.keep(packs, "queries")
    asked = packs.agg(F.sum("queries")).first()[0] or 0
    groups = -(-asked // QUERIES_AT_ONCE) or 1
    # an int as in the index rows: Spark deals ints and longs of one value to different tasks
    group = F.pmod(F.xxhash64("home"), F.lit(groups)).cast("int").alias("group")
    each = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    # the stated queries meet every block: a block's task holds one group of them
    every_block = F.explode(F.sequence(F.lit(0), F.lit(max(many, 1) - 1))).alias("block")
    asks = packs.select("home", "at", "ids", "rows", group, every_block)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            n = left.column("n")[0].as_py()
            get = lambda name, kind: np.frombuffer(left.column(name)[0].as_buffer(), kind)
            ids, matrix = get("ids", np.int64), get("matrix", np.int64).reshape(n, width)
            order, block = get("order", np.int32).reshape(n, width), left.column("block")[0].as_py()
            floats, largest = matrix.astype(np.float64), float(np.abs(matrix).max(initial=0))
            for home, *fields in zip(*(right.column(c) for c in ("home", "at", "ids", "rows"))):
                at, query_ids, rows = (np.frombuffer(x.as_buffer(), np.int64) for x in fields)
                for place, query_id, query in zip(at, query_ids, rows.reshape(len(at), width)):
                    skip = int(place) if home.as_py() == block else -1
                    best, scores, _ = threshold_search(matrix, order, ids, query, k, skip, floats, largest)
                    out += [(home.as_py(), int(place), int(query_id), int(ids[b]), int(s)) for b, s in zip(best, scores)]
        names = ["home", "place", "query_id", "vec_id", "score"]
        columns = list(zip(*out)) if out else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    found = each.groupBy("block", "group").cogroup(asks.groupBy("block", "group")).applyInArrow(
        search, "home bigint, place bigint, query_id bigint, vec_id bigint, score bigint"
    )
    best = Window.partitionBy("home", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
