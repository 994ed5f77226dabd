"""Mixing sources to target weights by fixed-length blocks of words."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WORD, handing_back, running_totals, stored


def fill_targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Targets in proportion to weights that sum to ``share`` of all sizes; none above ``most`` times its size."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] / total * left > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = weights[i] / total * left
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ -= over
    return out


def permuted(index: np.ndarray, size: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(size) at each index: a four-round Feistel network, walked until inside."""
    seeds = np.broadcast_to(np.asarray(seed, np.uint64) * np.uint64(1000003), index.shape)
    half = np.maximum((np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m = half[todo], mask[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            x = (right + seeds[todo] + np.uint64(turn * 7919 + 1)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((x ^ (x >> np.uint64(32))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Plan:
    """Per source (in order): words, blocks, target words, slots; and per output shard the slots of each source."""
    names: list
    sizes: list[int]
    blocks: list[int]
    targets: list[float]
    slots: list[int]
    drawn: np.ndarray
    seed: int


def plan_mix(totals: Sequence[tuple[str | None, int]], cycle: Sequence[float], share: float, most: float, block: int,
             shards: int, seed: int) -> Plan:
    """Targets by water filling, slots per source, and for each output shard a multinomial draw over what is left."""
    rows = sorted(totals, key=lambda r: (r[0] is None, r[0] or ""))
    names, sizes = [r[0] for r in rows], [int(r[1]) for r in rows]
    targets = fill_targets(sizes, [cycle[i % len(cycle)] for i in range(len(rows))], share, most)
    blocks = [-(-n // block) for n in sizes]
    slots = [min(round(t / n * b), int(most * b)) if n else 0 for t, n, b in zip(targets, sizes, blocks)]
    rng, left = np.random.default_rng(seed), np.array(slots, np.int64)
    drawn = np.zeros((shards, len(rows)), np.int64)
    for j in range(shards):
        need = int(left.sum()) // (shards - j)
        while need:
            got = np.minimum(rng.multinomial(need, left / left.sum()), left)
            drawn[j] += got
            left -= got
            need -= int(got.sum())
    return Plan(names, sizes, blocks, targets, slots, drawn, seed)


def draw_slots(spark, plan: Plan) -> DataFrame:
    """One row per output slot: shard, slot, source (its number), block (index in the source)."""
    drawn, seed = plan.drawn, plan.seed
    blocks, sources = np.array(plan.blocks, np.int64), max(1, drawn.shape[1])
    ends = np.cumsum(drawn.ravel())                          # after each source's slots in each shard
    earlier = np.cumsum(drawn, axis=0) - drawn               # slots of the source in earlier shards
    shard_ends = np.cumsum(drawn.sum(axis=1))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            stretch = np.searchsorted(ends, at, side="right")
            shard, source = stretch // sources, stretch % sources
            slot = at - np.where(shard > 0, shard_ends[shard - 1], 0)
            rank = earlier[shard, source] + at - np.where(stretch > 0, ends[stretch - 1], 0)
            size = blocks[source]
            turn = rank // np.maximum(size, 1)
            block = permuted(rank % np.maximum(size, 1), size, seed + 31 * turn + 1009 * source)
            # the place in the shard is mixed as well, so that sources do not follow one another
            mixed = permuted(slot, np.diff(np.concatenate([[0], shard_ends]))[shard], seed + 7 * shard + 3)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(mixed), pa.array(source.astype(np.int32)),
                                              pa.array(block)], ["shard", "slot", "source_no", "block"])

    total = int(shard_ends[-1]) if len(shard_ends) else 0
    parts = max(1, min(total // 200_000 + 1, 100_000))
    return spark.range(0, total, 1, parts).mapInArrow(handing_back(fill), "shard int, slot bigint, source_no int, block bigint")


@dataclass(frozen=True)
class Mix:
    """``rows``: every input row with size, source_size, target, taken and its row number; ``pieces``: the blocks'
    parts of each row with how often they are taken; ``slots``: the blocks of each output shard."""
    rows: DataFrame
    pieces: DataFrame
    slots: DataFrame
    plan: Plan


def mix_sources(docs: DataFrame, source: str = "source", order: str = "doc_id", cycle: Sequence[float] = (3, 1, 2),
                share: float = 1.5, most: float = 2.0, block: int = 64, shards: int = 64, seed: int = 20240611) -> Mix:
    """Mix the words of sources to target weights.

    ``docs`` is narrow: the source, the order column, ``size`` (words, null read as 0) and what the caller wants kept.
    The words of a source, in ``order``, are packed into blocks of ``block`` words; slots of output shards are mapped
    through pseudorandom permutations of a source's block indexes, so a block is taken once more only after all
    blocks of its source; blocks and rows meet by (source, block).  A null source is a source of its own; rows of
    size 0 take part with nothing; repeated rows are separate rows; an empty table gives none.  ``source_size`` and
    targets are kept on the driver, one row per source.
    """
    spark = docs.sparkSession
    base = stored(docs.withColumn("size", F.coalesce("size", F.lit(0)).cast("bigint"))
                  .withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    plan = plan_mix([tuple(r) for r in base.groupBy(source).agg(F.sum("size")).collect()], cycle, share, most, block,
                    shards, seed)
    facts = spark.createDataFrame([(i, n, s, float(t)) for i, (n, s, t) in enumerate(zip(plan.names, plan.sizes, plan.targets))],
                                  "source_no int, _name string, source_size bigint, target double")
    known = base.join(F.broadcast(facts) if len(plan.names) <= 10_000 else facts, base[source].eqNullSafe(facts["_name"])).drop("_name")
    # the stored rows of running_totals are read twice: for the pieces and for the result
    offset = stored(running_totals(known, ["source_no", order, "_row"], {"_start": "size"}, "mix-order", ["source_no"]), "mix-offsets")
    first, last = F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("size") - 1) / block)
    cut = (offset.where("size > 0").select("_row", "source_no", "size", "_start", F.explode(F.sequence(first, last)).alias("block"))
           .select("_row", "source_no", "block",
                   F.greatest(F.col("block") * block - F.col("_start"), F.lit(0)).alias("from_word"),
                   F.least((F.col("block") + 1) * block - F.col("_start"), F.col("size")).alias("to_word")))
    slots = draw_slots(spark, plan)
    times = slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    pieces = cut.join(times, ["source_no", "block"])
    taken = pieces.groupBy("_row").agg(F.sum((F.col("to_word") - F.col("from_word")) * F.col("times")).alias("taken"))
    rows = offset.join(taken, "_row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("bigint"))
    return Mix(rows.drop("_start", "source_no"), pieces, slots, plan)


def document_words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).alias("size"))


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them: same columns, the text made of the taken pieces in order, those taken
    twice following once more at the end; documents of which nothing is taken go.  ``n_chars`` is set anew."""
    base = stored(docs.withColumn("_key", F.monotonically_increasing_id()), "mix-texts")
    mix = mix_sources(base.select("_key", "doc_id", "source", F.regexp_count("text", F.lit(WORD)).alias("size")), **options)
    keys = mix.rows.select("_row", "_key")
    wanted = (mix.pieces.join(keys, "_row").groupBy("_key")
              .agg(F.sort_array(F.collect_list(F.struct("from_word", "to_word", "times"))).alias("_pieces")))

    names = list(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(WORD)
        for batch in batches:
            out = []
            for text, pieces in zip(batch.column("text").to_pylist(), batch.column("_pieces").to_pylist()):
                at = [m.span() for m in word.finditer(text)]
                runs = []
                for turn in range(1, max(p["times"] for p in pieces) + 1):
                    held: list[list[int]] = []
                    for p in pieces:
                        if p["times"] >= turn:
                            if held and held[-1][1] == p["from_word"]:
                                held[-1][1] = p["to_word"]
                            else:
                                held.append([p["from_word"], p["to_word"]])
                    runs += [text[at[a][0]:at[b - 1][1]] for a, b in held]
                out.append("\n".join(runs))
            columns = [pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = base.join(wanted, "_key").select(*docs.columns, "_pieces").mapInArrow(handing_back(cut), docs.schema)
    return rows.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else rows
