"""Shared helpers: written intermediate tables, gapless numbering, Arrow text batches, components."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tersa.workload.views import shared_folder

#: Rows of an Arrow batch: texts of 100 kB then make 50 MB.
BATCH_ROWS = 512
#: Text bytes that numpy works on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20


def workers_import_package(spark: SparkSession) -> None:
    """Python workers look for this package where the driver has it, whatever folder it was started in."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


class Scratch:
    """Intermediate tables below ``spark.checkpoint.dir``; they cut lineage and outlive executors.

    ``drop`` deletes tables that no later step reads. The tables that a returned DataFrame still
    reads stay, and belong to whoever cleans the cluster's checkpoint folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        workers_import_package(spark)
        self.spark, self.root = spark, shared_folder(spark, f"tersa-{name}")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def arrow_map(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator], schema, rows: int = BATCH_ROWS
) -> DataFrame:
    """``mapInArrow`` with batches of at most ``rows`` rows, so that memory is bounded.

    The bound is a setting of the session, which Spark reads when a job starts; the last one set stays.
    """
    workers_import_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df.mapInArrow(function, schema)


def text_column(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column and each row's offsets in them; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with at most ``limit`` bytes each, or one longer row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a public finaliser with good avalanche)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[key] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


class Words:
    """Words of consecutive rows: runs of bytes in a class, found and hashed by whole-array steps."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray):
        """is_word: byte -> bool; fold: byte -> byte, applied before words are hashed."""
        self.rows, n, self._sums = len(offsets) - 1, len(data), None
        self.data = fold[data]
        inside = np.zeros(n + 2, bool)
        inside[1 : n + 1] = is_word[self.data]
        starts = inside[1 : n + 1] & ~inside[:n]
        ends = inside[1 : n + 1] & ~inside[2:]
        edges = offsets[:-1][offsets[:-1] < offsets[1:]]  # a word never crosses into the next row
        starts[edges] |= inside[1 : n + 1][edges]
        ends[edges[1:] - 1] |= inside[edges[1:]]
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)  # each row's first word
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.counts)

    def hashes(self, first_bytes: int | None = None) -> np.ndarray:
        """64-bit hash of each word's bytes, or of its first ones."""
        n = len(self.data)
        up, down = _power_tables(n + 1)
        if self._sums is None:
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self._sums[1:])
        ends = self.ends if first_bytes is None else np.minimum(self.ends, self.starts + first_bytes)
        return mix((self._sums[ends] - self._sums[self.starts]) * down[self.starts])

    def text(self, first: int, last: int) -> bytes:
        """Words first to last - 1, joined by spaces."""
        return b" ".join(
            self.data[a:b].tobytes() for a, b in zip(self.starts[first:last], self.ends[first:last])
        )


def lower_ascii() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


def list_array(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list column from flat values and each row's number of them."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def slices(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of all bytes of the slices, one after the other."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


def chunk_rows(docs: DataFrame, size: int) -> DataFrame:
    """(payload, n_bytes): whole rows, about ``size`` text bytes together, as compressed Arrow streams."""

    def cut(batches):
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        for batch in batches:
            _, offsets = text_column(batch)
            for a, b in chunks(offsets, size):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                    out.write_batch(batch.slice(a, b - a))
                n = pa.array([offsets[b] - offsets[a]], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), n], names=["payload", "n_bytes"])

    return arrow_map(docs, cut, "payload binary, n_bytes bigint")


def read_chunk(payload) -> pa.RecordBatch:
    with pa.ipc.open_stream(payload) as stream:
        return stream.read_next_batch()


def with_row(df: DataFrame, name: str = "_row") -> DataFrame:
    """A number for each row. It is only stable once written: use it right before ``Scratch.keep``."""
    return df.withColumn(name, F.monotonically_increasing_id())


def gapless(df: DataFrame, rows: int, order: list, groups: list[str] = (), name: str = "rank") -> DataFrame:
    """Number the rows of each group from 0 without gaps, and without a group in one task.

    Rows are dealt to about sqrt(rows) buckets by hash; buckets are numbered inside, and a running
    sum over the buckets' counts gives where each begins. ``order`` must make rows distinct, or
    rows that are equal in it must be interchangeable.
    """
    groups = list(groups)
    buckets = max(1, int(rows ** 0.5))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order, F.lit("rank")), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*groups, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy(*order))
    ranked = dealt.withColumn("_inner", inner)
    same = [ranked[c].eqNullSafe(starts[c]) for c in groups] + [ranked["_bucket"] == starts["_bucket"]]
    joined = ranked.join(starts, same)
    return joined.select(
        *[ranked[c] for c in df.columns], (F.col("_start") + F.col("_inner") - 1).cast("long").alias(name)
    )


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that can be reached from each node of the edges.

    Alternating star contraction: every node hands its larger, then its smaller neighbours the
    smallest one it knows, until nothing changes. A round is two combined aggregates and joins
    over the edges; rounds grow with the logarithm of a component's size.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = scratch.keep(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc0")
    turn = 0
    while True:
        # larger neighbours move to the smallest neighbour
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that Spark can split a node with many neighbours in the join
        low = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), f"near{turn}")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # smaller neighbours, and the node itself, move to the smallest one
        low = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), f"least{turn}")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = small.union(low.select("u", F.col("m").alias("v"))).distinct()
        turn += 1
        after = scratch.keep(after, f"cc{turn}")
        moved = e.exceptAll(after).limit(1).count() + after.exceptAll(e).limit(1).count()
        scratch.drop(f"cc{turn - 1}", f"near{turn - 1}", f"least{turn - 1}")
        e = after
        if not moved:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def rows_by_text(docs: DataFrame, which: DataFrame, key: str, how: str) -> DataFrame:
    """The rows of docs (``left_semi``) in which, or not in it (``left_anti``): (_key, _hash) of the text; any column names may be there."""
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text_hash = F.xxhash64(F.coalesce("row.text", F.lit("")))
    return kept.join(which, F.col(f"row.`{key}`").eqNullSafe(F.col("_key")) & (text_hash == F.col("_hash")), how).select("row.*")


def hold(column: str | Column) -> Column:
    """crc32 of a number's decimal text, as the fold of labelled rows is defined."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"))
