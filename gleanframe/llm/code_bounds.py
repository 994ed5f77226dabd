"""Vector code compression: codebooks per part, trained with Drake and Hamerly's adaptive bounds in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gleanframe.operators.order_stats import attach_unique
from gleanframe.session import shared_folder

from .common import removed

MOST = 6                    # bounds that a part can keep
FEW, GROWN = 50, 20         # bounds are dropped that fewer than 1 in 50 parts need; one is added where more than 1 in 20 need all entries
FAR = np.iinfo(np.int32).max
LARGEST = 1 << 27           # components in whole units; squared distances of up to 128 components then fit a long
PARTS_STATE = np.dtype([("code", "u1"), ("held", "u1"), ("near", "u1", MOST), ("upper", "i4"), ("lower", "i4", MOST), ("outer", "i4")])


def finite(vector: Column) -> Column:
    """True for vectors without null or non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def common_length(vectors: DataFrame, vector: str) -> int | None:
    """The most frequent length of the vectors, of equally frequent ones the largest."""
    found = vectors.groupBy(F.size(vector).alias("n")).agg(F.count("*").alias("rows")).agg(F.max(F.struct("rows", "n")).alias("m")).first()
    return found.m.n if found.m else None


def root_below(square: np.ndarray) -> np.ndarray:
    r = np.floor(np.sqrt(square.astype(np.float64))).astype(np.int64)
    r -= r * r > square
    return r + ((r + 1) * (r + 1) <= square)


def root_above(square: np.ndarray) -> np.ndarray:
    r = root_below(square)
    return r + (r * r < square)


def ordered(x: np.ndarray, book: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its entries from near to far (ties: lower index first), and their squared distances."""
    apart = book[entries] - x[:, None, :]
    square = (apart * apart).sum(axis=2)
    order = np.lexsort((entries, square), axis=1)
    return np.take_along_axis(entries, order, 1), np.take_along_axis(square, order, 1)


def assign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, state: np.ndarray, bounds: int) -> np.ndarray:
    """Bring the state of one part position up to date with a codebook whose entries moved at most so far; for each row
    how many of its bounded entries had to be looked at (MOST + 1: all entries).

    ``upper`` is at least the distance to the row's entry, ``lower`` at most those to the entries in ``near``, and
    ``outer`` at most that to any other entry.  All are whole numbers, rounded away from certainty, so a strict
    inequality decides; whatever it leaves open is settled by exact squared distances.
    """
    count = len(book)
    upper = np.minimum(state["upper"].astype(np.int64) + moved[state["code"]], FAR)
    lower = state["lower"].astype(np.int64) - moved[state["near"]]
    held = np.minimum(state["held"], bounds)
    outer = np.where(state["outer"] == FAR, FAR, state["outer"].astype(np.int64) - moved.max(initial=0))
    place = np.arange(MOST)
    lower[place >= state["held"][:, None]] = FAR
    if bounds < MOST:
        outer = np.minimum(outer, lower[:, bounds:].min(axis=1))
        lower[:, bounds:] = FAR
    from_here = np.concatenate([lower, outer[:, None]], axis=1)                # at place z: at most any distance from z on
    from_here = np.minimum.accumulate(from_here[:, ::-1], axis=1)[:, ::-1]

    def needed(rows) -> np.ndarray:
        sure = upper[rows, None] < from_here[rows]
        return np.where(sure.any(axis=1), sure.argmax(axis=1), MOST + 1)

    need = needed(slice(None))
    open_ = np.flatnonzero(need)
    if len(open_):                                                             # a tight upper bound may settle it
        apart = book[state["code"][open_]] - x[open_]
        upper[open_] = np.minimum(root_above((apart * apart).sum(axis=1)), FAR)
        need[open_] = needed(open_)
    code, near = state["code"].copy(), state["near"].copy()
    for z in np.unique(need[need > 0]):
        rows = np.flatnonzero(need == z)
        if z > MOST:
            entry, square = ordered(x[rows], book, np.tile(np.arange(count), (len(rows), 1)))
            keep = min(bounds, count - 1)
            held[rows] = keep
            outer[rows] = np.minimum(root_below(square[:, keep + 1]), FAR - 1) if count > keep + 1 else FAR
        else:
            z = int(z)
            entry, square = ordered(x[rows], book, np.concatenate([code[rows, None], near[rows, :z]], axis=1).astype(np.int64))
            keep = z
        code[rows], upper[rows] = entry[:, 0], np.minimum(root_above(square[:, 0]), FAR)
        near[rows, :keep] = entry[:, 1:keep + 1]
        lower[rows, :keep] = np.minimum(root_below(square[:, 1:keep + 1]), FAR - 1)
    near[place >= held[:, None]] = 0
    state["code"], state["held"], state["near"], state["upper"] = code, held, near, upper
    state["lower"], state["outer"] = np.maximum(lower, -FAR), np.maximum(outer, -FAR)
    return need


def next_bounds(used: np.ndarray, bounds: int) -> int:
    """How many bounds a part position keeps from now on, from how many parts needed 0, 1, ... MOST, or all entries."""
    total, short = int(used.sum()), int(used[-1])
    if short * GROWN > total:
        return min(bounds + 1, MOST)
    beyond = np.cumsum(used[:-1][::-1])[::-1]                                  # beyond[z]: parts that needed z or more
    return max(1, next((z for z in range(1, bounds) if beyond[z + 1] * FEW < total), bounds))


@dataclass(frozen=True)
class Codes:
    """``rows``: the codes; ``books``: per part position the final entries, whole numbers; ``bounds``: per round and part
    position how many bounds were kept."""
    rows: DataFrame
    books: list[np.ndarray]
    bounds: list[list[int]]


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for entry in book.tolist() for v in entry).encode()).hexdigest()


def _numbers(column: pa.Array, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(rows, -1).astype(np.int64)


def code_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8,
                 entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codes:
    """Each vector's code: per part the nearest of ``entries`` codebook entries, two hex digits each.

    Components become floor(scale * x).  Codebooks start as the vectors of smallest key and follow ``rounds`` rounds
    of assignment and floored means; unused entries stay.  A round's state (each part's entry and bounds) is a table in
    the shared folder, and each task writes with it what its rows changed in the sums, so the driver sees entries,
    never rows.

    Vectors that are null, hold null or non-finite components, differ from the most frequent length or cannot be cut
    into ``parts`` take no part.  Components beyond 2**27 units are taken as that.  Null keys come last among the
    first vectors, of equal keys the smaller vector first; repeated rows are coded each; null labels are one label;
    other columns are not looked at; without vectors there are no rows.
    """
    spark = vectors.sparkSession
    narrow = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    kept = narrow.where(finite(F.col("v")) & (F.size("v") % parts == 0))
    id_kind, label_kind = (narrow.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    out = f"vec_id {id_kind}, label {label_kind}, code string, error bigint"
    length = common_length(kept, "v")
    if length is None:
        return Codes(spark.createDataFrame([], f"vec_id {id_kind}, code string, error bigint, label_error bigint, codebooks_sha256 string"), [], [])
    kept, width = kept.where(F.size("v") == length), length // parts

    def whole(values: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(values * scale), -LARGEST, LARGEST).astype(np.int64)

    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = whole(np.array([r.v for r in first]).reshape(len(first), length))
    books = [start[:, p * width:(p + 1) * width].copy() for p in range(parts)]
    count = len(first)
    shape = (parts, count, width)
    sums, counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
    moved, bounds, history = [np.zeros(count, np.int64)] * parts, [min(4, MOST)] * parts, []
    columns = f"vec_id {id_kind}, label {label_kind}, x binary, state binary, tally array<bigint>"

    def round_(books, moved, bounds, begin: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            added, more, used = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64), np.zeros((parts, MOST + 2), np.int64)
            names, kinds = ["vec_id", "label", "x", "state", "tally"], None
            for batch in batches:
                n = batch.num_rows
                kinds = [batch.schema.field(i).type for i in range(2)]
                if not n:
                    continue
                if begin:
                    x = whole(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, length))
                    state = np.zeros((n, parts), PARTS_STATE)
                    state["upper"], state["lower"] = FAR, -FAR
                else:
                    x = _numbers(batch.column(2), n)
                    state = np.frombuffer(b"".join(batch.column(3).to_pylist()), PARTS_STATE).reshape(n, parts).copy()
                for p in range(parts):
                    part, own = x[:, p * width:(p + 1) * width], state[:, p].copy()
                    was = own["code"].copy()
                    used[p] += np.bincount(assign(part, books[p], moved[p], own, bounds[p]), minlength=MOST + 2)
                    state[:, p] = own
                    change = np.arange(n) if begin else np.flatnonzero(was != own["code"])
                    for k in np.unique(np.concatenate([was[change], own["code"][change]])):
                        come, gone = change[own["code"][change] == k], change[was[change] == k] if not begin else change[:0]
                        added[p, k] += part[come].sum(axis=0) - part[gone].sum(axis=0)
                        more[p, k] += len(come) - len(gone)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary()),
                     pa.array([r.tobytes() for r in state], pa.binary()), pa.nulls(n, pa.list_(pa.int64()))], names)
            if kinds:
                tally = np.concatenate([added.ravel(), more.ravel(), used.ravel()])
                yield pa.RecordBatch.from_arrays([pa.nulls(1, kinds[0]), pa.nulls(1, kinds[1]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                                                  pa.array([tally], pa.list_(pa.int64()))], names)
        return run

    rows, path = kept.select("vec_id", "label", "v"), None
    for turn in range(rounds):
        history.append(list(bounds))
        earlier, path = path, shared_folder(spark, "codes")
        rows.mapInArrow(round_(books, moved, bounds, turn == 0), columns).write.parquet(path)
        if earlier:
            removed(spark, earlier)
        table = spark.read.schema(columns).parquet(path)
        totals = table.where("tally IS NOT NULL").select(F.posexplode("tally").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()
        tally = np.zeros(sums.size + counts.size + parts * (MOST + 2), np.int64)
        tally[[r.i for r in totals]] = [r.n for r in totals]
        sums += tally[:sums.size].reshape(shape)
        counts += tally[sums.size:sums.size + counts.size].reshape(shape[:2])
        used = tally[sums.size + counts.size:].reshape(parts, MOST + 2)
        renewed = [np.where(counts[p][:, None] > 0, sums[p] // np.maximum(counts[p], 1)[:, None], books[p]) for p in range(parts)]
        moved = [root_above(((a - b) ** 2).sum(axis=1)) for a, b in zip(renewed, books)]
        books, bounds = renewed, [next_bounds(used[p], bounds[p]) if turn else bounds[p] for p in range(parts)]
        rows = table.where("tally IS NULL").drop("tally")
    history.append(list(bounds))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _numbers(batch.column(2), n)
            state = np.frombuffer(b"".join(batch.column(3).to_pylist()), PARTS_STATE).reshape(n, parts).copy()
            error, codes = np.zeros(n, np.int64), np.zeros((n, parts), np.uint8)
            for p in range(parts):
                part, own = x[:, p * width:(p + 1) * width], state[:, p].copy()
                assign(part, books[p], moved[p], own, bounds[p])
                codes[:, p] = own["code"]
                apart = books[p][own["code"]] - part
                error += (apart * apart).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)],
                                             ["vec_id", "label", "code", "error"])

    path = shared_folder(spark, "codes")
    rows.mapInArrow(finish, out).write.parquet(path)
    coded = spark.read.schema(out).parquet(path)
    shared = coded.withColumn("label", F.struct("label"))                      # a struct, so that null equals null
    totals = shared.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    done = attach_unique(shared, totals, ["label"], "n", ["label_error"])
    return Codes(done.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")), books, history)
