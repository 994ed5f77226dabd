"""Removal of long repeated byte strings by run-length indexes (run-compressed Burrows-Wheeler transforms).

Every string of LENGTH bytes has one anchor: its leftmost smallest hash of GRAM bytes.  Equal strings have equal
anchors at equal places, so only texts' snippets around equal anchors need to be compared, and these meet by a
shuffle.  Equal snippets are counted; different ones are indexed, group by group, and matching statistics say which of
their strings occur twice.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleanframe.operators.order_stats import attach_unique
from gleanframe.session import shared_folder

from .common import Hashes, joined_bytes, mixed, slices, stored

LENGTH = 400
GRAM = 32
CROWD = 2_000            # different snippets of one anchor that are indexed together; larger groups are split by content
WIDTH = 32               # strings of a part, when such groups are split
INDEX_BYTES = 1 << 20    # bytes that one index is built over, unless one group has more
SEPARATOR = 255          # never occurs in UTF-8
PLACE_BITS = 30


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(text, anchor hash, snippet hash, first string, number of strings, place of the anchor after the first string).

    A row stands for the strings of one text that share an anchor; they start one after another.
    """
    empty = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    wide = np.flatnonzero(sizes >= length)
    if not len(wide):
        return empty, empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty
    hashes = Hashes(raw)
    window = length - gram + 1
    places = np.arange(len(raw) - gram + 1)
    grams = hashes.of(places, places + gram)
    low = np.uint64((1 << PLACE_BITS) - 1)
    keys = (grams & ~low) | places.astype(np.uint64)
    padded = np.concatenate([keys, np.full(-len(keys) % window, ~np.uint64(0))]).reshape(-1, window)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    count = sizes[wide] - length + 1
    start = np.repeat(offsets[:-1][wide] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    at = (np.minimum(behind[start], ahead[start + window - 1]) & low).astype(np.int64)
    text = np.repeat(wide, count)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    number = np.diff(np.concatenate([first, [len(at)]]))
    begin, place, text = start[first], at[first], text[first]
    content = hashes.of(begin, begin + number + length - 1)
    snippet = mixed(content + (place - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return text, grams[place], snippet, begin - offsets[text], number, place - begin


def suffix_array(raw: np.ndarray) -> np.ndarray:
    """All suffixes in order, by doubling; only suffixes still tied are sorted again."""
    n = len(raw)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = raw
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | wide[k:n + k]
    order = np.argsort(key)
    ranked = key[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    tied = ~fresh | np.concatenate([~fresh[1:], [False]])
    slots, step = np.flatnonzero(tied), 8
    while len(slots):
        rows = order[slots]
        later = rows + step
        second = np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
        key = (rank[rows].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        by = np.argsort(key)
        rows, key = rows[by], key[by]
        order[slots] = rows
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[rows] = np.maximum.accumulate(np.where(fresh, slots, 0))
        tied = ~fresh | np.concatenate([~fresh[1:], [False]])
        slots, step = slots[tied], step * 2
    return order


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform with the suffixes at both ends of every run.

    Inside a run a suffix and its neighbour are preceded by the same byte, so what they share is one byte less than
    what the text's preceding place shares with its neighbour: matching statistics need comparing at run ends only.
    """

    def __init__(self, raw: np.ndarray):
        order = suffix_array(raw)
        transform = raw[order - 1]                                   # the place before 0 is the last one, a separator
        head = np.flatnonzero(np.concatenate([[True], transform[1:] != transform[:-1]]))
        head = np.union1d(head, np.flatnonzero(order == 0))          # the text's first place continues nothing
        head = np.union1d(head, np.minimum(np.flatnonzero(order == 0) + 1, len(raw) - 1))
        self.raw, self.symbols = raw, transform[head]
        self.lengths = np.diff(np.concatenate([head, [len(raw)]]))
        self.first = order[head]                                     # suffixes at run starts
        self.last = order[np.concatenate([head[1:], [len(raw)]]) - 1]   # and at run ends

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at a and at b share."""
        padded = np.concatenate([self.raw, np.zeros(8, np.uint8)])
        eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
        out, todo = np.zeros(len(a), np.int64), np.arange(len(a))
        while len(todo):
            x, y = a[todo] + out[todo], b[todo] + out[todo]
            inside = np.maximum(x, y) < len(self.raw)
            x, y = np.minimum(x, len(self.raw)), np.minimum(y, len(self.raw))
            equal = eights[x] == eights[y]
            run = np.where(equal.all(axis=1), 8, np.argmin(equal, axis=1))
            out[todo] += np.where(inside, run, 0)
            todo = todo[inside & (run == 8)]
        return np.minimum(out, np.minimum(len(self.raw) - a, len(self.raw) - b))

    def matching_statistics(self) -> np.ndarray:
        """For every place of the text the length of its longest match that starts elsewhere."""
        best = np.zeros(len(self.raw), np.int64)
        for at, other, edge in ((self.first[1:], self.last[:-1], self.first[:1]), (self.last[:-1], self.first[1:], self.last[-1:])):
            if not len(at):
                continue
            value = np.full(len(self.raw), -1, np.int64)
            value[at] = self._shared(at, other)
            # between sampled places, in text order, a match gets one byte shorter at each step
            value[edge] = np.maximum(value[edge], 0)                  # the outermost suffix has no neighbour on this side
            known = np.maximum.accumulate(np.where(value >= 0, np.arange(len(value)), 0))
            np.maximum(best, np.maximum(value[known] - (np.arange(len(value)) - known), 0), out=best)
        return best


def repeated_starts(snippets: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each snippet, per string of ``length`` bytes in it, whether the string also starts elsewhere in the list."""
    raw = np.frombuffer(bytes([SEPARATOR]).join(snippets) + bytes([SEPARATOR]), np.uint8)
    match = RunLengthIndex(raw).matching_statistics()
    starts = np.cumsum([0, *[len(s) + 1 for s in snippets]])[:-1]
    return [match[a:a + len(s) - length + 1] >= length for a, s in zip(starts, snippets)]


def _ranges(flags: np.ndarray) -> list[dict]:
    """Runs of true as half-open ranges."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2])]


RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _found(h: list, s: list, ranges: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(s, pa.int64()), pa.array(ranges, RANGES)], ["anchor", "snippet", "ranges"])


def index_groups(snippets: DataFrame, length: int) -> DataFrame:
    """(anchor, snippet, content) in, (anchor, snippet, ranges of strings that another snippet of the anchor holds)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, s, content = [], [], []
        held = 0

        def solved(n: int) -> pa.RecordBatch:
            flags = repeated_starts(content[:n], length)
            hit = [i for i, f in enumerate(flags) if f.any()]
            out = _found([h[i] for i in hit], [s[i] for i in hit], [_ranges(flags[i]) for i in hit])
            del h[:n], s[:n], content[:n]
            return out

        for batch in batches:
            for anchor, snippet, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if held >= INDEX_BYTES and anchor != h[-1]:
                    yield solved(len(h))
                    held = 0
                h.append(anchor)
                s.append(snippet)
                content.append(text)
                held += len(text) + 1
        if h:
            yield solved(len(h))

    return (snippets.repartition("anchor").sortWithinPartitions("anchor", "snippet").select("anchor", "snippet", "content")
            .mapInArrow(run, "anchor bigint, snippet bigint, ranges array<struct<a: bigint, b: bigint>>"))


def counted_strings(snippets: DataFrame, length: int) -> DataFrame:
    """(anchor, snippet, place, content) in, ranges out, for groups that no more dealing out makes smaller: their
    strings are told apart by 64 bits of the anchor, the distance from it and 64 bits of content, and counted."""
    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = np.frombuffer(batch.column(3)[i].as_py(), np.uint8)
                n = len(text) - length + 1
                starts = np.arange(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(batch.column(0)[i], n), pa.repeat(batch.column(1)[i], n), pa.array(starts),
                     pa.array(starts - batch.column(2)[i].as_py()), pa.array(Hashes(text).of(starts, starts + length).view(np.int64))],
                    ["anchor", "snippet", "start", "shift", "string"])

    rows = snippets.select("anchor", "snippet", "place", "content").mapInArrow(
        strings, "anchor bigint, snippet bigint, start bigint, shift bigint, string bigint")
    twice = rows.groupBy("anchor", "shift", "string").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    hit = rows.join(twice, ["anchor", "shift", "string"]).groupBy("anchor", "snippet").agg(F.sort_array(F.collect_set("start")).alias("starts"))
    return hit.select("anchor", "snippet", F.transform("starts", lambda x: F.struct(x.alias("a"), (x + 1).alias("b"))).alias("ranges"))


def split_crowds(snippets: DataFrame, length: int, width: int = WIDTH) -> DataFrame:
    """The same for anchors with very many snippets, which are dealt out by more of their content.

    (anchor, snippet, place, content) in.  Snippets are cut into parts whose strings start within ``width`` bytes at
    equal distances from the anchor; all strings of a part hold the same core, so parts meet by core.  Equal parts are
    counted, different ones indexed; only crowds that share even the core are counted string by string.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for anchor, snippet, place, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                hashes, last = Hashes(np.frombuffer(body, np.uint8)), len(body) - length
                a = 0
                while a <= last:
                    low = (a - place) // width * width + place            # where the part's range of strings begins
                    b = min(low + width - 1, last)
                    ends = np.array([low + length, b + length])
                    core, whole = hashes.of(np.array([low + width - 1, a]), ends)
                    key = mixed(np.array([np.uint64(anchor & 0xFFFFFFFFFFFFFFFF) + core * np.uint64(0x9E3779B97F4A7C15) + np.uint64((low - place) & 0xFFFFFFFF)]))
                    part = mixed(np.array([whole + np.uint64(a - low)]))
                    out.append((anchor, snippet, a, b - a + 1, int(key.view(np.int64)[0]), int(part.view(np.int64)[0]), low - a, body[a:b + length]))
                    a = b + 1
            types = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types],
                                             ["anchor", "snippet", "first", "number", "key", "part", "place", "content"])

    parts = stored(snippets.select("anchor", "snippet", "place", "content").mapInArrow(
        cut, "anchor bigint, snippet bigint, first bigint, number bigint, key bigint, part bigint, place bigint, content binary"), "parts")
    kinds = parts.groupBy("key", "part").agg(F.count("*").alias("n"), F.max("number").alias("number"), F.max("place").alias("place"),
                                             F.any_value("content").alias("content"))
    several = parts.groupBy("key").agg(F.count("*").alias("all"), F.count_distinct("part").alias("kinds")).where(F.col("all") > 1)
    met = attach_unique(kinds, several.withColumn("rows", F.col("kinds")), ["key"], "rows", ["kinds"])     # hot cores by broadcast
    known = stored(met.select(F.col("key").alias("anchor"), F.col("part").alias("snippet"), "n", "number", "place", "kinds", "content"), "part-kinds")
    fully = known.where("n > 1").select("anchor", "snippet", F.array(F.struct(F.lit(0).cast("bigint").alias("a"), F.col("number").alias("b"))).alias("ranges"))
    partly = index_groups(known.where((F.col("kinds") > 1) & (F.col("kinds") <= CROWD)), length)
    counted = counted_strings(known.where(F.col("kinds") > CROWD), length)
    alone = known.where("n = 1").select("anchor", "snippet")
    ranges = fully.unionAll(partly.unionAll(counted).join(alone, ["anchor", "snippet"], "left_semi")).withColumnsRenamed({"anchor": "key", "snippet": "part"})
    return (parts.select("anchor", "snippet", "first", "key", "part").join(ranges, ["key", "part"])
            .select("anchor", "snippet", F.transform("ranges", lambda r: F.struct((F.col("first") + r["a"]).alias("a"), (F.col("first") + r["b"]).alias("b"))).alias("r"))
            .groupBy("anchor", "snippet").agg(F.flatten(F.collect_list("r")).alias("ranges")))


def _bucketed(df: DataFrame, columns: list[str], purpose: str) -> tuple[DataFrame, str]:
    """Write a table dealt by ``columns``, so that joins on them move the other side only, and its name."""
    spark = df.sparkSession
    name = f"{purpose}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.write.format("parquet").option("path", shared_folder(spark, purpose)).bucketBy(parts, *columns).sortBy(*columns).saveAsTable(name))
    return spark.table(name), name


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (removed byte ranges, ``start:end``, end exclusive).

    A byte is removed if a string of ``length`` bytes covers it that also starts anywhere else, in the same text or
    another; strings are judged on the input.  Null texts count as empty; texts shorter than ``length`` lose nothing;
    of repeated rows every one is removed whole if long enough; other columns are not looked at.  Texts are told apart
    by 128 bits, snippets of equal anchors by 64 more.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("doc_id"), whole.alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    unique = base.where(F.octet_length("text") >= length).groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.any_value("text").alias("text"))
    held, name = _bucketed(unique, ["k1", "k2"], "texts")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3, 2 << 20):
            doc, anchor, snippet, start, number, place = anchors(*joined_bytes(batch.column(3)), length)
            doc = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(doc) for i in range(3)] + [
                pa.array(anchor.view(np.int64)), pa.array(snippet.view(np.int64)), pa.array(start), pa.array(number), pa.array(place)],
                ["k1", "k2", "copies", "anchor", "snippet", "start", "number", "place"])

    found = stored(held.select("k1", "k2", "copies", "text").mapInArrow(
        find, "k1 bigint, k2 bigint, copies bigint, anchor bigint, snippet bigint, start bigint, number bigint, place bigint"), "anchors")
    kinds = found.groupBy("anchor", "snippet").agg(F.sum("copies").alias("n"), F.min(F.struct("k1", "k2", "start", "number", "place")).alias("at"))
    several = kinds.groupBy("anchor").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).where("all > 1")
    known = stored(kinds.join(several, "anchor").select("anchor", "snippet", "n", "kinds", "at.*"), "snippets")

    wanted = known.where("kinds > 1").groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "snippet", "start", "number", "place", "kinds")).alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, 2 << 20):
            out = []
            for body, cuts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = body.encode()
                out += [(c["anchor"], c["snippet"], c["place"], c["kinds"], body[c["start"]:c["start"] + c["number"] + length - 1]) for c in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.binary()])],
                                             ["anchor", "snippet", "place", "kinds", "content"])

    taken = stored(held.join(wanted, ["k1", "k2"]).select("text", "cuts").mapInArrow(
        cut, "anchor bigint, snippet bigint, place bigint, kinds bigint, content binary"), "contents")
    partly = index_groups(taken.where(F.col("kinds") <= CROWD), length)
    crowded = split_crowds(taken.where(F.col("kinds") > CROWD), length)
    fully = known.where("n > 1").select("anchor", "snippet", F.array(F.struct(F.lit(0).cast("bigint").alias("a"), F.col("number").alias("b"))).alias("ranges"))
    alone = known.where("n = 1").select("anchor", "snippet")
    ranges = fully.unionAll(partly.unionAll(crowded).join(alone, ["anchor", "snippet"], "left_semi"))
    spans = (found.select("k1", "k2", "anchor", "snippet", "start").join(ranges, ["anchor", "snippet"])
             .select("k1", "k2", F.transform("ranges", lambda r: F.struct((F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"] - 1 + length).alias("b"))).alias("r"))
             .groupBy("k1", "k2").agg(F.flatten(F.collect_list("r")).alias("spans")))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 4 << 20):
            out = []
            for body, given in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                body, merged = body.encode(), []
                for a, b in sorted((r["a"], r["b"]) for r in given):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                digest, at = hashlib.sha256(), 0
                for a, b in merged:
                    digest.update(body[at:a])
                    at = b
                digest.update(body[at:])
                out.append((sum(b - a for a, b in merged), len(merged), digest.hexdigest(), ",".join(f"{a}:{b}" for a, b in merged)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(
                zip(*out), [pa.int64(), pa.int64(), pa.string(), pa.string()])]], ["k1", "k2", "n_removed", "n_spans", "kept", "spans"])

    cleaned = held.join(spans, ["k1", "k2"]).select("k1", "k2", "text", "spans").mapInArrow(
        strip, "k1 bigint, k2 bigint, n_removed bigint, n_spans bigint, kept string, spans string")
    narrow = base.select("doc_id", "k1", "k2", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("all_sha256"))
    out = stored(narrow.join(cleaned, ["k1", "k2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
        F.coalesce("kept", "all_sha256").alias("kept_sha256"), F.coalesce("spans", F.lit("")).alias("spans")), "repeats")
    docs.sparkSession.sql(f"DROP TABLE {name}")                # the catalog's entry; its files stay in the shared folder
    return out
