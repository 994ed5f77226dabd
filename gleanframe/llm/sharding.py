"""Shards along a Hilbert curve through several metadata dimensions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import running_totals, stored


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers in [0, 2**bits)."""
    x = [c.astype(np.int64).copy() for c in cells.T]
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(turned, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ t) >> bit) & 1)
    return out


@dataclass(frozen=True)
class Dimension:
    """A metadata column of the curve: ``kind`` is linear or log for numbers, text for strings (by sorted rank)."""
    column: str
    kind: str = "linear"


def _cells(df: DataFrame, dims: Sequence[Dimension], bits: int) -> list[Column]:
    """Cell numbers by value range (numbers) or by cumulated rank of the distinct values (texts); null is cell 0."""
    top = (1 << bits) - 1
    scaled = {d.column: F.col(d.column).cast("double") if d.kind == "linear" else F.log2(F.greatest(F.col(d.column), F.lit(0)) + 1)
              for d in dims if d.kind != "text"}
    bounds = df.agg(F.count("*"), *[f(c) for c in scaled.values() for f in (F.min, F.max)]).first()[1:] if scaled else ()
    out = []
    for d in dims:
        if d.kind == "text":
            out.append(F.coalesce(F.col(f"_cell_{d.column}"), F.lit(0)))
            continue
        k = list(scaled).index(d.column) * 2
        low, high = bounds[k] or 0.0, bounds[k + 1] or 0.0
        width = (high - low) or 1.0
        out.append(F.coalesce(F.least(F.floor((scaled[d.column] - low) / width * (top + 1)), F.lit(top)), F.lit(0)).cast("int"))
    return out


def _with_ranks(df: DataFrame, dims: Sequence[Dimension], bits: int) -> DataFrame:
    """For text dimensions: distinct values in order, cut into 2**bits - 1 even classes after the null cell."""
    for d in dims:
        if d.kind != "text":
            continue
        values = df.where(F.col(d.column).isNotNull()).select(d.column).distinct().withColumn("_one", F.lit(1))
        ranked = running_totals(values, [d.column], {"_rank": "_one"}, "ranks")
        total = F.lit(max(ranked.count(), 1))
        cell = (F.floor(F.col("_rank") * ((1 << bits) - 1) / total) + 1).cast("int")
        df = df.join(ranked.select(d.column, cell.alias(f"_cell_{d.column}")), d.column, "left")
    return df


def shard_by_curve(df: DataFrame, dims: Sequence[Dimension], size: str, ties: Sequence[str], shards: int = 40,
                   bits: int = 8) -> DataFrame:
    """``df`` (narrow metadata rows) with ``curve``, ``shard`` and ``slot``.

    Rows are ordered by curve index, then by ``ties``, and cut into ``shards`` runs of near equal total ``size``:
    a row goes to the shard in which its middle byte falls.  Slots count a shard's rows from 0 without gaps.  Nulls
    take cell 0; an empty table gives no rows; repeated rows are separate rows.  Shards without rows may occur if
    one row is larger than a shard.
    """
    base = stored(df.withColumn("_row", F.monotonically_increasing_id()), "shard-rows")
    ranked = _with_ranks(base, dims, bits)

    names, cells = [*df.columns, "_row"], [f"_cell{i}" for i in range(len(dims))]

    def curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in cells], axis=1)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(hilbert_index(points, bits))], names=[*names, "curve"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    placed = (ranked.select(*names, *[c.alias(n) for c, n in zip(_cells(base, dims, bits), cells)])
              .mapInArrow(curve, f"{fields}, curve bigint").withColumn("_one", F.lit(1)))
    summed = stored(running_totals(placed, ["curve", *ties, "_row"], {"_before": size, "_index": "_one"}, "curve"), "curve-sums")
    total = summed.agg(F.sum(size)).first()[0] or 1
    middle = F.col("_before").cast("double") + F.col(size) / 2.0
    cut = summed.withColumn("shard", F.least(F.floor(middle * shards / F.lit(float(total))), F.lit(shards - 1)).cast("int"))
    firsts = cut.groupBy("shard").agg(F.min("_index").alias("_first"))         # at most `shards` rows
    return (cut.join(F.broadcast(firsts), "shard")
            .select(*df.columns, "curve", "shard", (F.col("_index") - F.col("_first")).alias("slot")))


def shard_ranges(sharded: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest value of each column per shard: what file pruning works with."""
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *[f(c).alias(f"{n}_{c}") for c in columns
                                                                       for n, f in (("min", F.min), ("max", F.max))])


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, each sorted by slot."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, size (UTF-8 bytes, null: none, plus 16) and text_crc32 (null text: 0)."""
    return docs.select("doc_id", "lang", "source",
                       (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"),
                       F.coalesce(F.crc32("text"), F.lit(0)).alias("text_crc32"))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Documents along source, language, size and id; equal texts of the same cell lie side by side."""
    dims = (Dimension("source", "text"), Dimension("lang", "text"), Dimension("size", "log"), Dimension("doc_id"))
    return shard_by_curve(document_sizes(docs), dims, "size", ("text_crc32", "doc_id"), shards)
