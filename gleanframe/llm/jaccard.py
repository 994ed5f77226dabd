"""Near duplicates: a Jaccard join of word shingles with count vectors in R-trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import LOWER_BYTES, components, handing_back, joined_bytes, mixed, slices, stored, word_hashes

SHINGLE, PERCENT = 5, 80
GROUPS = 512           # coordinates of a count vector; unrelated sets of n shingles are told apart up to n of about 25 times this
FAMILY = 2_000         # texts that one task joins together; larger families are joined in blocks
WEIGHT = 4_000_000     # shingles that one task joins together, unless a text alone has more
HEAVY = 200_000        # frequent shingles that are put last in the order of prefixes (any order gives the same result)
SLICE = 1 << 20        # text bytes whose shingles a task makes at a time


def shingle_sets(column: pa.Array | pa.ChunkedArray, width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles; texts of fewer words are one shingle as a whole."""
    batch = pa.RecordBatch.from_arrays([column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column], ["text"])
    return [s for part in slices([batch], 0, SLICE) for s in _sets(part.column(0), width)]


def _sets(column: pa.Array, width: int) -> list[np.ndarray]:
    raw, offsets = joined_bytes(column)
    words, doc = word_hashes(LOWER_BYTES[raw], offsets)
    number = np.bincount(doc, minlength=len(offsets) - 1)
    ends = np.cumsum(number)

    def chained(at: np.ndarray, k: int) -> np.ndarray:
        acc = np.full(len(at), k, np.uint64)
        for j in range(k):
            acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + words[at + j])
        return acc

    all_ = chained(np.arange(max(len(words) - width + 1, 0)), width)
    out = []
    for n, end in zip(number.tolist(), ends.tolist()):
        found = np.sort(all_[end - n:end - width + 1]) if n >= width else chained(np.array([end - n]), n) if n else words[:0]
        out.append(found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) > 1 else found)
    return out


def count_vector(shingles: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    counts = np.bincount((mixed(shingles + np.uint64(1)) % np.uint64(groups)).astype(np.int64), minlength=groups)
    return counts.astype(np.uint16 if counts.max() < 1 << 16 else np.int32)


def least_overlap(n, m, percent: int = PERCENT):
    """The smallest intersection with which sets of n and m elements are similar enough."""
    return -(-percent * (n + m) // (100 + percent))


class CountTree:
    """An R-tree, packed by size and then by coordinates, of count vectors; rows can be taken out."""

    FAN = 16

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((*vectors.T[:2], sizes))
        self.rows, self.vectors, self.sizes = order, vectors[order], sizes[order]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.alive = np.ones(len(order), bool)
        self.levels = []
        top, low, high, left = self.vectors, self.sizes, self.sizes, np.ones(len(order), np.int64)
        while len(top) > 1:
            cuts = np.arange(0, len(top), self.FAN)
            top, low, high = np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            left = np.add.reduceat(left, cuts)
            self.levels.append((top, low, high, left))

    def remove(self, row: int) -> None:
        at = self.place[row]
        if self.alive[at]:
            self.alive[at] = False
            for level in self.levels:
                at //= self.FAN
                level[3][at] -= 1

    def near(self, vector: np.ndarray, size: int, percent: int = PERCENT) -> np.ndarray:
        """Rows whose overlap with the vector, bounded by the sum of coordinate minima, may be large enough."""
        spots = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high, left = self.levels[depth]
            spots = spots[left[spots] > 0]
            bound = np.minimum(top[spots], vector).sum(axis=1, dtype=np.int64)
            fits = (bound >= least_overlap(size, low[spots], percent)) & (100 * high[spots] >= percent * size) & (percent * low[spots] <= 100 * size)
            below = len(self.levels[depth - 1][0]) if depth else len(self.rows)
            spots = (spots[fits][:, None] * self.FAN + np.arange(self.FAN)).ravel()
            spots = spots[spots < below]
        spots = spots[self.alive[spots]]
        bound = np.minimum(self.vectors[spots], vector).sum(axis=1, dtype=np.int64)
        return self.rows[spots[bound >= least_overlap(size, self.sizes[spots], percent)]]


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


def classes_of(sets: list[np.ndarray] | None, vectors: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """For each row the first row of its class; links are verified by the sets, or taken from the bound without them.

    Breadth-first from each row not yet reached, looking only among rows not yet reached: a class of mutually similar
    rows costs one search, not one per pair.
    """
    tree, label = CountTree(vectors, sizes), np.full(len(sizes), -1, np.int64)
    for first in range(len(sizes)):
        if label[first] >= 0:
            continue
        label[first] = first
        tree.remove(first)
        queue = [first]
        while queue:
            at = queue.pop()
            for row in tree.near(vectors[at], int(sizes[at]), percent):
                if sets is None or similar(sets[at], sets[row], percent):
                    label[row] = first
                    tree.remove(row)
                    queue.append(row)
    return label


def _runs(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.Table]:
    """The rows of each key (the first columns), of batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        bounds = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _vectors(column) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.uint16 if len(v) == 2 * GROUPS else np.int32) for v in column.to_pylist()])


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) if pairs else np.zeros(0, np.int64) for x in (zip(*pairs) if pairs else ((), ())))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=EDGE)


def frequent_shingles(docs: DataFrame, text: str = "text", bound: int = HEAVY) -> np.ndarray:
    """Shingles that recur within slices of documents, rarest first; at most ``bound``, which only sets an order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, SLICE):
            tokens, n = np.unique(np.concatenate([*shingle_sets(batch.column(0)), np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[n >= 3].view(np.int64)), pa.array(n[n >= 3].astype(np.int64))], ["token", "n"])

    seen = docs.select(text).mapInArrow(handing_back(run), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    rows = seen.orderBy(F.col("n").desc(), "token").limit(bound).toArrow()
    token = rows.column("token").to_numpy()
    return token[np.lexsort((token, rows.column("n").to_numpy()))].view(np.uint64)


def described(docs: DataFrame, heavy: np.ndarray, percent: int) -> DataFrame:
    """For (doc_id, text, t1, t2), per row: all but the text, the size of the shingle set, 128 bits that identify the
    set, its count vector and its prefix.

    Two similar sets share an element among their first n - ceil(percent * n / 100) + 1, whatever order is used for
    all; here frequent shingles come last.
    """
    sorted_heavy, rank = np.sort(heavy), np.argsort(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SLICE):
            sets = shingle_sets(batch.column(1))
            n = [len(s) for s in sets]
            first, second, vectors, prefixes = [], [], [], []
            for s in sets:
                first.append(int(mixed(s + np.uint64(11)).sum(dtype=np.uint64).view(np.int64)))
                second.append(int(mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)))
                vectors.append(count_vector(s).tobytes())
                at = np.searchsorted(sorted_heavy, s)
                common = (at < len(heavy)) & (sorted_heavy[np.minimum(at, max(len(heavy) - 1, 0))] == s) if len(heavy) else np.zeros(len(s), bool)
                last = s[common][np.argsort(rank[at[common]], kind="stable")]
                keep = len(s) + (percent * len(s)) // -100 + 1 if len(s) else 0
                prefixes.append(np.concatenate([s[~common], last])[:keep].view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(vectors, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*prefixes, np.zeros(0, np.int64)])))],
                ["doc_id", "t1", "t2", "n_shingles", "k1", "k2", "vector", "prefix"])

    return docs.mapInArrow(handing_back(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t1 bigint, t2 bigint, n_shingles bigint, k1 bigint, "
                                "k2 bigint, vector binary, prefix array<bigint>")


def coarse_edges(nodes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect, at least by a path, any two sets that can be similar.

    Sets that share a prefix shingle form a bucket.  Buckets with the same members are searched once.  Small ones are
    searched by count vectors; in large ones all members are tied to the smallest, which needs no gathering.
    """
    rows = nodes.select("node", F.explode("prefix").alias("token"))
    shared = rows.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    every = stored(rows.join(shared, "token"), "shared")
    marked = every.groupBy("token", "n").agg(F.min("node").alias("low"), F.bit_xor(F.xxhash64("node")).alias("s1"),
                                             F.bit_xor(F.xxhash64("node", F.lit(1))).alias("s2"))
    once = marked.groupBy("n", "s1", "s2").agg(F.min("token").alias("token"), F.min("low").alias("low")).select("token", "low")
    members = stored(every.join(once, "token").select("token", "node", "n", "low"), "buckets")
    large = members.where(F.col("n") > FAMILY).select(F.col("node").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
    small = (members.where(F.col("n") <= FAMILY).select("token", "node")
             .join(nodes.select("node", "n_shingles", "vector"), "node").select("token", "node", "n_shingles", "vector"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _batched(_runs(batches)):
            token, node, size = (table.column(i).to_numpy() for i in range(3))
            vectors = _vectors(table.column(3))
            bounds = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]])
            length, pairs = np.diff(bounds), []
            for k in np.unique(length[length <= 8]):                   # tiny buckets all at once
                at = bounds[:-1][length == k]
                for i in range(k):
                    for j in range(i + 1, k):
                        a, b = at + i, at + j
                        hit = np.minimum(vectors[a], vectors[b]).sum(axis=1, dtype=np.int64) >= least_overlap(size[a], size[b], percent)
                        pairs.append((node[a[hit]], node[b[hit]]))
            for a, b in zip(bounds[:-1][length > 8], bounds[1:][length > 8]):
                label = classes_of(None, vectors[a:b], size[a:b], percent)
                own = np.arange(b - a) != label
                pairs.append((node[a:b][own], node[a:b][label[own]]))
            yield _edges(pairs)

    found = small.repartition("token").sortWithinPartitions("token").mapInArrow(handing_back(search), "a bigint, b bigint")
    return found.distinct().unionAll(large)


def _batched(runs: Iterator[pa.Table], rows: int = 20_000) -> Iterator[pa.Table]:
    """Several whole runs together."""
    held, n = [], 0
    for run in runs:
        held.append(run)
        n += run.num_rows
        if n >= rows:
            yield pa.concat_tables(held)
            held, n = [], 0
    if held:
        yield pa.concat_tables(held)


def _local(percent: int):
    """(key..., node, text) in, edges (node, first node of its class within the key) out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 2):
            node, sets = table.column(2).to_numpy(), shingle_sets(table.column(3))
            label = classes_of(sets, np.stack([count_vector(s) for s in sets]), np.array([len(s) for s in sets]), percent)
            yield _edges([(node, node[label])])
    return run


def _parts(rows: DataFrame, name: str, salt: int) -> DataFrame:
    """Give each row of a family one of ``name`` parts, each of about FAMILY texts and WEIGHT shingles at most."""
    total = rows.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / FAMILY), F.ceil(F.sum("n") / WEIGHT)).alias("_parts"))
    return (rows.join(total, "family").withColumn(name, F.pmod(F.xxhash64("node", F.lit(salt)), F.col("_parts")).cast("bigint"))
            .withColumnRenamed("_parts", f"{name}s"))


def exact_edges(families: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between similar sets whose paths are all the links of ``families`` (family, node, n, text).

    A family that one task can hold is joined by it.  A larger one is cut into blocks: each is joined by itself; the
    first texts of the blocks' classes are joined next; whatever then lies outside the family's largest class is
    searched in every block.  Texts of the largest class need no search among themselves, so the work follows the
    number of texts, and the number of those outside.
    """
    def joined(parts: DataFrame, name: str) -> DataFrame:
        return (parts.repartition("family", name).select("family", name, "node", "text").sortWithinPartitions("family", name)
                .mapInArrow(handing_back(_local(percent)), "a bigint, b bigint"))

    placed = stored(_parts(families, "block", 1), "blocks")
    edges = stored(joined(placed, "block"), "local-links")
    large = placed.where("blocks > 1")
    if large.isEmpty():
        return edges
    roots = large.join(edges.select(F.col("b").alias("node")).distinct(), "node").select("family", "node", "n", "text")
    merged = stored(joined(_parts(roots, "part", 7), "part"), "root-links")
    label = components(edges.join(large.select(F.col("node").alias("a")), "a", "left_semi").unionAll(merged))
    named = large.select("family", "node").join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    count = named.groupBy("family", "root").agg(F.count("*").alias("texts"))
    biggest = count.groupBy("family").agg(F.max_by("root", F.struct("texts", "root")).alias("big"))
    labelled = large.join(named.join(biggest, "family").select("node", "root", "big"), "node")
    asked = (_parts(labelled.where("root <> big").select("family", "node", "n", "root", "blocks", "text"), "chunk", 3)
             .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
             .select("family", "block", "chunk", "node", "root", "text", F.lit(True).alias("asked")))
    chunks = asked.select("family", "block", "chunk").distinct()
    held = labelled.join(chunks, ["family", "block"]).select("family", "block", "chunk", "node", "root", "text", F.lit(False).alias("asked"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 3):
            node, root = table.column(3).to_numpy(), table.column(4).to_numpy()
            query = table.column(6).to_numpy().astype(bool)
            sets = shingle_sets(table.column(5))
            vectors, sizes = np.stack([count_vector(s) for s in sets]), np.array([len(s) for s in sets])
            here, pairs = np.flatnonzero(~query), []
            if not len(here):
                continue
            tree = CountTree(vectors[here], sizes[here])
            for q in np.flatnonzero(query):
                met = {root[q]}
                for row in here[tree.near(vectors[q], int(sizes[q]), percent)]:
                    if root[row] not in met and similar(sets[q], sets[row], percent):
                        met.add(root[row])
                        pairs.append((node[q:q + 1], node[row:row + 1]))
            yield _edges(pairs)

    more = (asked.unionAll(held).repartition("family", "block", "chunk").sortWithinPartitions("family", "block", "chunk")
            .mapInArrow(handing_back(across), "a bigint, b bigint"))
    return edges.unionAll(merged).unionAll(stored(more, "across-links"))


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, text, t1, t2): with 128 bits that identify the text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("t1"), F.xxhash64(F.lit(1), whole).alias("t2"))


def _classified(narrow: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, t1, t2, n_shingles, k1, k2, row) and, for every set that is not empty, (k1, k2, n_shingles, root, least):
    the smallest node of its class and the smallest id among its own rows."""
    heavy = frequent_shingles(narrow)
    rows = stored(described(narrow, heavy, percent).withColumn("row", F.monotonically_increasing_id()), "shingles")
    full = rows.where("n_shingles > 0")
    groups = stored(full.groupBy("k1", "k2", "n_shingles").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"),
                                                              F.min_by(F.struct("t1", "t2"), "row").alias("at")), "nodes")
    nodes = full.join(groups.select(F.col("node").alias("row"), "node"), "row").select("node", "n_shingles", "vector", "prefix")
    coarse = components(coarse_edges(nodes, percent))
    ties = coarse.select("root").distinct()
    member = coarse.unionAll(ties.select(F.col("root").alias("node"), "root")).distinct()
    wanted = stored(member.join(groups, "node").select(F.col("root").alias("family"), "node", F.col("n_shingles").alias("n"), "at.t1", "at.t2"), "wanted")
    families = stored(_fetched(narrow, wanted), "families")
    links = components(exact_edges(families, percent))
    reached = groups.join(links, "node", "left").withColumn("root", F.coalesce("root", "node")).select("k1", "k2", "n_shingles", "root", "least")
    return rows.drop("vector", "prefix"), reached


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach, the document itself included).

    Two documents link when their sets of 5-word shingles have a Jaccard similarity of at least ``percent`` / 100.
    Equal sets are one node; nodes that share a prefix shingle are searched by R-trees over count vectors, survivors
    are verified on their sets.  Shingles are told apart by 64-bit hashes.  Null, empty and wordless texts have the
    empty set and link with nothing (their component is their own id); repeated rows link with one another; a null
    id's component is the smallest id it reaches, else null; other columns are not looked at.
    """
    rows, reached = _classified(_marked(docs, key, text), percent)
    least = reached.groupBy("root").agg(F.min("least").alias("component_id"))
    known = reached.join(least, "root").select("k1", "k2", "n_shingles", "component_id")
    out = rows.select("doc_id", "n_shingles", "k1", "k2").join(known, ["k1", "k2", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _fetched(narrow: DataFrame, wanted: DataFrame) -> DataFrame:
    """(family, node, n, text): the text of every wanted node, which names one by its 128 bits; copies come once."""
    # by a shuffle at every size: wanted rows grow with the corpus, so a broadcast that fits now says nothing later
    joined = narrow.join(wanted.hint("merge"), ["t1", "t2"]).select("text", "family", "node", "n")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None                                       # joined rows of a text follow one another
        for batch in batches:
            node, keep = batch.column(2).to_numpy(), []
            for i, x in enumerate(node.tolist()):
                if x != last:
                    keep.append(i)
                    last = x
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(1), kept.column(2), kept.column(3), kept.column(0)], ["family", "node", "n", "text"])

    return joined.mapInArrow(handing_back(once), "family bigint, node bigint, n bigint, text string").dropDuplicates(["node"])


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` without near duplicates: of each class the row with the smallest id stays, of equal ids and texts one.

    Wordless texts are no near duplicates of anything; rows equal in id and text stay once.  The winners of the
    classes are narrow rows; texts move once, to meet them.
    """
    rows, reached = _classified(_marked(docs, key, text), percent)
    named = rows.join(reached.select("k1", "k2", "n_shingles", "root"), ["k1", "k2", "n_shingles"], "left")
    own = named.withColumn("class", F.coalesce("root", -1 - F.col("row")))
    first = own.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "t1", "t2")).alias("w"))
    winners = first.select(F.col("w.doc_id").alias("_id"), F.col("w.t1").alias("_w1"), F.col("w.t2").alias("_w2"))
    whole = F.coalesce(F.col(text), F.lit(""))
    placed = docs.withColumns({"_t1": F.xxhash64(whole), "_t2": F.xxhash64(F.lit(1), whole)})
    met = placed.join(winners.hint("merge"), (F.col("_t1") == F.col("_w1")) & (F.col("_t2") == F.col("_w2")) & F.col(key).eqNullSafe(F.col("_id")), "left_semi")
    rest = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name != text and f.dataType.simpleString() in ("string", "int", "bigint", "double", "boolean")]
    turn = F.row_number().over(Window.partitionBy("_t1", "_t2", key).orderBy(*rest))
    return met.withColumn("_turn", turn).where("_turn = 1").drop("_turn", "_t1", "_t2")
