"""What the operators share: stored tables, slices of Arrow batches, running totals, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gleanframe.session import shared_folder

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text bytes that a task looks at together; longer texts come alone.
SLICE_BYTES = 4 << 20


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table once to the shared folder and go on from there: lost executors cost no recomputation."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def handing_back(run):
    """A task function that gives freed memory back when it ends: Python workers outlive their tasks, and what one
    stage has freed but not returned would count against the next."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
        if trim:
            trim(0)
    return wrapped


def text_sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batches: Iterable[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``limit`` bytes of its text column; whole texts always."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(text_sizes(batch.column(text)))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(column: pa.Array) -> list[str]:
    """Null is read as the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and the n + 1 places where texts start or end; null is empty."""
    filled = pc.fill_null(column, "")
    if isinstance(filled, pa.ChunkedArray):
        filled = filled.combine_chunks()
    data = filled.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(data) + 1]
    body = data.buffers()[2]
    raw = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0xD6E8FEB86659FD93)                      # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that lets every bit act on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any stretch of a byte array, from prefix sums modulo 2**64."""

    def __init__(self, raw: np.ndarray):
        powers = np.full(len(raw) + 1, _BASE, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=self.sums[1:])
        powers[:] = _INVERSE
        powers[0] = 1
        self.back = np.cumprod(powers, out=powers)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.back[start])


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, text number) of every word of the texts whose bytes lie between the offsets."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~_IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(solid & (~np.concatenate([[False], solid[:-1]]) | edge[:-1]))
    stop = np.flatnonzero(solid & (~np.concatenate([solid[1:], [False]]) | edge[1:])) + 1
    h = mixed(Hashes(raw).of(start, stop) + (stop - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return h, np.searchsorted(offsets, start, side="right") - 1


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def running_totals(df: DataFrame, order: Sequence[str], amounts: dict[str, str], purpose: str,
                   groups: Sequence[str] = ()) -> DataFrame:
    """Add, for each ``new: amount``, the sum of the amount over the earlier rows of the row's group.

    Rows are dealt by ranges of ``order`` (which begins with the non-null ``groups``), so no group, however large,
    meets in one task: a range is summed by itself, and only one total per range and group is summed up over ranges.
    Rows that are equal in all of ``order`` should not exist; give a unique column last.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    placed = stored(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), purpose)
    totals = placed.groupBy(*groups, "_range").agg(*[F.sum(a).alias(f"_all_{n}") for n, a in amounts.items()])
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*groups, "_range", *[F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_base_{n}")
                                               for n in amounts])
    own = Window.partitionBy(*groups, "_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.select("*", *[F.coalesce(F.sum(a).over(own), F.lit(0)).alias(f"_own_{n}") for n, a in amounts.items()])
    joined = inner.join(bases, [*groups, "_range"])
    return joined.select(*[c for c in placed.columns if c != "_range"],
                         *[(F.col(f"_own_{n}") + F.col(f"_base_{n}")).alias(n) for n in amounts])


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the smallest node that links reach.

    Alternating large-star and small-star rounds; each is written to the shared folder, until nothing changes.
    Stars are formed by map-side combined minima, so no neighbourhood is gathered in one task.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                 purpose)
    while True:
        both = now.select("a", "b").union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .distinct())
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(floor, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                                                 F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
                                                         ).alias("e"))
                 .select("e.a", "e.b").where("a <> b").distinct())
        after = stored(small, purpose)
        signs = [t.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFF)))
                 .first() for t in (now, after)]
        now = after
        if signs[0] == signs[1]:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
