"""Approximate nearest neighbours: a forest of sorted hash strings, descended to the longest common prefixes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .code_bounds import common_length, finite
from .common import stored

BITS = 32                   # length of a hash string


@dataclass(frozen=True)
class Forest:
    """``trees`` sorted arrays of hash strings per block of about ``block`` vectors.

    The descent stops at the longest prefixes that ``first`` times k vectors share with the query; the ascent at the
    longest prefix that a vector as near as the k-th found so far shares with the query in some tree with probability
    ``recall`` or more.
    """
    trees: int = 40
    block: int = 8192
    first: int = 4
    recall: float = 0.9
    seed: int = 77


def directions(rule: Forest, length: int) -> np.ndarray:
    """One random direction per bit of each tree; the last component belongs to the added coordinate."""
    return np.random.default_rng(rule.seed).standard_normal((length + 1, rule.trees * BITS))


def hash_strings(x: np.ndarray, planes: np.ndarray, longest: float) -> np.ndarray:
    """(rows, trees): the hash strings of vectors as numbers.

    A coordinate is added that gives all vectors the norm of the longest, so that the largest inner product with a
    query is the smallest angle.
    """
    unit = x / longest
    added = np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1)))
    bits = np.concatenate([unit, added[:, None]], axis=1) @ planes > 0
    packed = np.packbits(bits.reshape(len(x), -1, BITS), axis=2)
    return packed.view(">u4")[:, :, 0].astype(np.uint64)


def query_strings(q: np.ndarray, planes: np.ndarray) -> np.ndarray:
    return hash_strings(q / np.sqrt((q * q).sum(axis=1))[:, None], planes, 1.0)


class Block:
    """The sorted hash strings of one block of vectors."""

    def __init__(self, row: np.ndarray, name: np.ndarray, x: np.ndarray, planes: np.ndarray, longest: float):
        self.row, self.name, self.x = row, name, x
        strings = np.concatenate([hash_strings(part, planes, longest) for part in np.array_split(x, max(1, len(x) // 1024))])
        self.order = np.argsort(strings, axis=0, kind="stable").T.copy()
        self.sorted = [strings[o, t] for t, o in enumerate(self.order)]

    def ranges(self, strings: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(trees, queries): from where to where the sorted strings share ``depth`` bits with the query's."""
        room = (BITS - depth).astype(np.uint64)
        low = (strings >> room[:, None]) << room[:, None]
        high = low + (np.uint64(1) << room)[:, None]
        start = np.stack([np.searchsorted(s, low[:, t]) for t, s in enumerate(self.sorted)])
        return start, np.stack([np.searchsorted(s, high[:, t]) for t, s in enumerate(self.sorted)])

    def descend(self, strings: np.ndarray, least: int) -> np.ndarray:
        """For each query the longest prefix that ``least`` entries share with it in all trees together, else 0."""
        low, high = np.zeros(len(strings), np.int64), np.full(len(strings), BITS, np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            start, stop = self.ranges(strings, middle)
            enough = (stop - start).sum(axis=0) >= least
            low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
        return low

    def search(self, row: int, q: np.ndarray, start: np.ndarray, stop: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best among the entries of the ranges, the query's own row left out."""
        hit = np.zeros(len(self.row), bool)
        for order, a, b in zip(self.order, start.tolist(), stop.tolist()):
            hit[order[a:b]] = True
        at = np.flatnonzero(hit)
        at = at[self.row[at] != row]
        if len(at) > k:                                    # a product of matrices rounds by place: it only sorts out
            rough = self.x[at] @ q
            kth = np.partition(rough, len(rough) - k)[len(rough) - k]
            at = at[rough >= kth - 1e-9 * max(1.0, abs(kth))]
        score = (self.x[at] * q).sum(axis=1)
        best = np.lexsort((self.name[at], -score))[:k]
        return at[best], score[best]


def reach(kth: np.ndarray, norm: np.ndarray, longest: float, rule: Forest) -> np.ndarray:
    """The longest prefix that a vector of score ``kth`` shares with the query in at least one tree often enough."""
    share = 1.0 - np.arccos(np.clip(kth / (norm * longest), -1.0, 1.0)) / math.pi
    needed = 1.0 - (1.0 - rule.recall) ** (1.0 / rule.trees)
    with np.errstate(divide="ignore"):
        depth = np.floor(math.log(needed) / np.log(np.clip(share, 1e-12, 1.0 - 1e-12)))
    return np.clip(depth, 0, BITS).astype(np.int64)


FOUND = "query_row bigint, query_id bigint, row bigint, vec_id bigint, score double"


def _visits(points: DataFrame, queries: DataFrame, blocks: int, length: int, longest: float, k: int, rule: Forest) -> DataFrame:
    """Every query visits every block: a task holds one block and lets the queries pass.

    ``queries`` have the score of their k-th best so far in ``kth``; where it is null they descend, else they ascend.
    """
    asked = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(True))
    held = points.select("row", "vec_id", "v", F.lit(None).cast("double").alias("kth"), "block", F.lit(False).alias("asks"))
    both = held.unionByName(asked).repartition("block").sortWithinPartitions("block", "asks").select("block", "asks", "row", "vec_id", "v", "kth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, now, parts, block = directions(rule, length), None, [], None
        for batch in batches:
            number, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            cuts = [0, *(np.flatnonzero((number[1:] != number[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if number[a] != now:
                    now, parts, block = number[a], [], None
                row, name, kth = (batch.column(i).slice(a, b - a).to_numpy(zero_copy_only=False) for i in (2, 3, 5))
                x = batch.column(4).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, length)
                if not asks[a]:
                    parts.append((row, name, x))
                    continue
                if block is None:
                    if not parts:
                        continue
                    block = Block(*map(np.concatenate, zip(*parts)), planes, longest)
                for c in range(0, b - a, 512):
                    q, strings = x[c:c + 512], query_strings(x[c:c + 512], planes)
                    score = kth[c:c + 512].astype(np.float64)
                    fresh = np.isnan(score)
                    depth = np.where(fresh, 0, reach(np.where(fresh, 0, score), np.sqrt((q * q).sum(axis=1)), longest, rule))
                    if fresh.any():
                        depth[fresh] = block.descend(strings[fresh], rule.first * k)
                    start, stop = block.ranges(strings, depth)
                    found = [block.search(int(row[c + i]), q[i], start[:, i], stop[:, i], k) for i in range(len(q))]
                    n = [len(f[0]) for f in found]
                    at = np.concatenate([f[0] for f in found])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(row[c:c + 512], n)), pa.array(np.repeat(name[c:c + 512], n)), pa.array(block.row[at]),
                         pa.array(block.name[at]), pa.array(np.concatenate([f[1] for f in found]))], ["query_row", "query_id", "row", "vec_id", "score"])

    return both.mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, rule: Forest = Forest()) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose key ``every`` divides the k others of largest inner product.

    Every vector is indexed: dealt to a block by its row, its hash strings sorted there, tree by tree.  First each query
    descends, in every block, to the longest prefixes that enough vectors share with it.  The k-th best of what all
    blocks found bounds the k-th best from below, hence the angle of what may be missing, and so says how far the query
    has to ascend, in all trees together: near neighbours need long prefixes only, far ones short ones.  Queries with
    fewer than k found ascend to the root, which holds all vectors.

    Vectors that are null, zero, hold null or non-finite components, differ from the most frequent length or have no
    key take no part.  Repeated rows are vectors of their own and find one another; other columns are not looked at;
    an empty table gives no rows.
    """
    v = F.col(vector).cast("array<double>")
    usable = vectors.select(F.col(key).cast("bigint").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & finite(F.col("v")) & F.exists("v", lambda x: x != 0))
    length = common_length(usable, "v")
    if length is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = stored(usable.where(F.size("v") == length).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, longest = rows.agg(F.count("*"), F.max(norm)).first()
    blocks = -(-n // rule.block)
    points = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    queries = rows.where(F.col("vec_id") % every == 0).select("row", "vec_id", "v")
    visit = lambda q: _visits(points, q, blocks, length, longest, k, rule)
    met = stored(_best(visit(queries.withColumn("kth", F.lit(None).cast("double"))), k), "descent")
    bound = met.where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("kth"))
    again = queries.join(bound, "row", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
    found = visit(again).unionByName(met.drop("rank")).distinct()
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
