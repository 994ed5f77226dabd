"""Language-model scores by context-tree weighting over bytes, beside a smoothed word model."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LOWER_BYTES, SLICE_BYTES, joined_bytes, slices, stored, word_hashes

DEPTH = 5                          # context bytes; up to 7 fit the 64-bit code
HEAD_WORDS, HEAD_GRAMS = 200_000, 500_000   # the most frequent ones are sent to all tasks; all others meet by a join
WORDS, GRAMS, SUMMARY = 0, 1, 2    # kinds of rows
END = np.uint64(0x1D0C5E17E4D)     # stands for the end of a text among the word hashes
LN10 = math.log(10.0)


def tokens_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, text number) of every word of lower-cased texts, and of one END per text."""
    words, doc = word_hashes(raw, offsets)
    docs = np.arange(len(offsets) - 1)
    return np.concatenate([words, np.full(len(docs), END)]), np.concatenate([doc, docs])


def gram_codes(raw: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte the code of its context and itself (the byte lowest, the nearest context byte next), and its text.

    Texts begin after ``depth`` zero bytes.
    """
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(raw)) + depth * (doc + 1)
    padded = np.zeros(len(raw) + depth * len(sizes), np.uint64)
    padded[place] = raw
    code = np.zeros(len(raw), np.uint64)
    for k in range(depth + 1):
        code |= padded[place - k] << np.uint64(8 * k)
    return code, doc


def log_gamma(x: np.ndarray) -> np.ndarray:
    product, y = np.ones_like(x), x + 8
    for k in range(8):
        product = product * (x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov block probability (natural logarithm) of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1.0)


def log_weighted(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Half the own estimate, half the product of the children."""
    return math.log(0.5) + np.logaddexp(own, below)


class Level:
    """The nodes of one context depth for one bit place: counts, weighted probability, and the weight of the own estimate."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.key, self.zeros, self.ones = key, zeros, ones
        kt = log_kt(zeros, ones)
        self.weighted = kt if below is None else log_weighted(kt, below)
        self.own = np.ones(len(key)) if below is None else np.exp(math.log(0.5) + kt - self.weighted)

    def mixed(self, at: np.ndarray, bit: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """Probability of the bit at the node, over this and the deeper levels; one half where nothing was seen."""
        n = self.zeros[at] + self.ones[at]
        here = (np.where(bit, self.ones[at], self.zeros[at]) + 0.5) / (n + 1.0)
        return np.where(n > 0, self.own[at] * here + (1 - self.own[at]) * deeper, 0.5)


def _grouped(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, for each row the place of its key, sums per key."""
    unique, place = np.unique(key, return_inverse=True)
    return unique, place, [np.bincount(place, weights=v, minlength=len(unique)) for v in values]


def bit_levels(code: np.ndarray, n: np.ndarray, place: int, depth: int, least: int):
    """Levels depth .. least for one bit place, each with the place of every gram in it, deepest first; and the bits."""
    byte = code & np.uint64(255)
    node = (np.uint64(1) << np.uint64(place)) | (byte >> np.uint64(8 - place))
    bit = ((byte >> np.uint64(7 - place)) & np.uint64(1)).astype(bool)
    key = (code >> np.uint64(8)) & np.uint64((1 << (8 * depth)) - 1)
    unique, at, (zeros, ones) = _grouped(key << np.uint64(8) | node, np.where(bit, 0, n), np.where(bit, n, 0))
    level = Level(unique, zeros, ones, None)
    out = [(level, at)]
    for d in range(depth - 1, least - 1, -1):       # a level is summed up from the nodes of the one below it
        below = np.where(level.zeros + level.ones > 0, level.weighted, 0.0)
        unique, parent, sums = _grouped(level.key & np.uint64((1 << (8 * (d + 1))) - 1), level.zeros, level.ones, below)
        level, at = Level(unique, *sums), parent[at]
        out.append((level, at))
    return out, bit


def root_levels(sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """From rows (nearest byte, node, zeros, ones, log-probability of the children) the two top levels as dense arrays."""
    zeros, ones, below = (np.zeros((256, 256)) for _ in range(3))
    near, node = sums[:, 0].astype(int), sums[:, 1].astype(int)
    for target, column in ((zeros, 2), (ones, 3), (below, 4)):
        np.add.at(target, (near, node), sums[:, column])
    kt = log_kt(zeros, ones)
    weighted = log_weighted(kt, below)
    own = np.exp(math.log(0.5) + kt - weighted)
    top_zeros, top_ones = zeros.sum(axis=0), ones.sum(axis=0)
    top_kt = log_kt(top_zeros, top_ones)
    top_own = np.exp(math.log(0.5) + top_kt - log_weighted(top_kt, np.where(zeros + ones > 0, weighted, 0.0).sum(axis=0)))
    return zeros, ones, own, top_zeros, top_ones, top_own


def gram_logs(code: np.ndarray, n: np.ndarray, roots: tuple[np.ndarray, ...], depth: int) -> np.ndarray:
    """log10 probability of each gram's byte in its context: eight bits, each mixed over all depths."""
    zeros, ones, own, top_zeros, top_ones, top_own = roots
    near = ((code >> np.uint64(8)) & np.uint64(255)).astype(int)
    total = np.zeros(len(code))
    for place in range(8):
        levels, bit = bit_levels(code, n, place, depth, 2)
        p = np.full(len(code), 0.5)
        for level, at in levels:
            p = level.mixed(at, bit, p)
        node = ((1 << place) | ((code & np.uint64(255)) >> np.uint64(8 - place)).astype(int))
        for z, o, w in ((zeros[near, node], ones[near, node], own[near, node]), (top_zeros[node], top_ones[node], top_own[node])):
            here = (np.where(bit, o, z) + 0.5) / (z + o + 1.0)
            p = np.where(z + o > 0, w * here + (1 - w) * p, 0.5)
        total += np.log(p)
    return total / LN10


class Tally:
    """Counts by key, summed up within a task as long as they are few."""

    def __init__(self, most: int = 1_500_000):
        self.keys, self.counts, self.held, self.most = [], [], 0, most

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > self.most:
            self._sum()

    def _sum(self) -> None:
        keys, counts = np.concatenate([*self.keys, np.zeros(0, np.uint64)]), np.concatenate([*self.counts, np.zeros(0, np.int64)])
        unique, place = np.unique(keys, return_inverse=True)
        self.keys, self.counts = [unique], [np.bincount(place, weights=counts, minlength=len(unique)).astype(np.int64)]
        self.held = len(unique)

    def drain(self, least: int = 0) -> tuple[np.ndarray, np.ndarray] | None:
        if self.held and self.held >= least:
            self._sum()
            if self.held >= least:
                out = self.keys[0], self.counts[0]
                self.keys, self.counts, self.held = [], [], 0
                return out
        return None


def _prepared(docs: DataFrame, key: str, text: str) -> DataFrame:
    held = F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(5)) == 1, F.lit(False))
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), held.alias("held_out"))


def corpus_counts(docs: DataFrame, depth: int) -> DataFrame:
    """(kind, item, n): the training count of every training word, and of every gram of any text (then also 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {WORDS: Tally(), GRAMS: Tally()}

        def emit(kind: int, found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), kind, np.int32)), pa.array(found[0].view(np.int64)), pa.array(found[1])],
                                              ["kind", "item", "n"])

        for batch in slices(batches, 1):
            raw, offsets = joined_bytes(batch.column(1))
            raw = LOWER_BYTES[raw]
            trained = ~batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            words, doc = tokens_of(raw, offsets)
            tallies[WORDS].add(*np.unique(words[trained[doc]], return_counts=True))
            codes, doc = gram_codes(raw, offsets, depth)
            for use in (trained, ~trained):
                found, n = np.unique(codes[use[doc]], return_counts=True)
                tallies[GRAMS].add(found, n if use is trained else np.zeros_like(n))
            for kind, tally in tallies.items():
                if found := tally.drain(1_200_000):
                    yield emit(kind, found)
        for kind, tally in tallies.items():
            if found := tally.drain():
                yield emit(kind, found)

    return docs.mapInArrow(run, "kind int, item bigint, n bigint").groupBy("kind", "item").agg(F.sum("n").alias("n"))


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams and counts of batches sorted by their two nearest context bytes; those of one pair stay together."""
    codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        codes = np.concatenate([codes, batch.column(1).to_numpy().view(np.uint64)])
        counts = np.concatenate([counts, batch.column(2).to_numpy()])
        if len(codes) >= least:
            pair = (codes >> np.uint64(8)) & np.uint64(0xFFFF)
            cut = int(np.searchsorted(pair, pair[-1]))
            if cut:
                yield codes[:cut], counts[:cut]
                codes, counts = codes[cut:], counts[cut:]
    if len(codes):
        yield codes, counts


def gram_model(counts: DataFrame, depth: int) -> DataFrame:
    """(item, n, log10 probability) of every gram: trees are summed up per pair of nearest bytes, then at the driver
    for the two top levels (at most 256 times 255 rows), and mixed on the way down."""
    grams = (counts.where(F.col("kind") == GRAMS)
             .withColumn("pair", F.expr(f"shiftright(item, 8) & {0xFFFF}")).select("pair", "item", "n"))
    ready = grams.repartition("pair").sortWithinPartitions("pair", "item")

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, n in _whole_groups(batches):
            for place in range(8):
                level = bit_levels(code, n, place, depth, 2)[0][-1][0]
                near = ((level.key >> np.uint64(8)) & np.uint64(255)) << np.uint64(8) | (level.key & np.uint64(255))
                some = level.zeros + level.ones > 0
                unique, _, sums = _grouped(near[some], level.zeros[some], level.ones[some], level.weighted[some])
                yield pa.RecordBatch.from_arrays([pa.array((unique >> np.uint64(8)).astype(np.int32)), pa.array((unique & np.uint64(255)).astype(np.int32)),
                                                  *map(pa.array, sums)], ["near", "node", "zeros", "ones", "below"])

    top = (ready.mapInArrow(climb, "near int, node int, zeros double, ones double, below double")
           .groupBy("near", "node").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).orderBy("near", "node").toPandas())
    roots = root_levels(top.to_numpy(float).reshape(-1, 5))

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, n in _whole_groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n), pa.array(gram_logs(code, n, roots, depth))],
                                             ["item", "n", "value"])

    return ready.mapInArrow(descend, "item bigint, n bigint, value double")


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Both models learn from the texts that are not held out.  ``score`` is the log10 probability of the lower-cased
    text's bytes: each byte is eight binary decisions, each with a tree of contexts of up to ``depth`` bytes, whose
    Krichevsky-Trofimov estimates are mixed over all depths by their weights after training.  ``bits_per_byte`` is
    its code length (0 for empty texts).  A null text counts as empty and scores its end only; a null id is trained
    on; repeated rows are scored each by itself; an empty table gives no rows.  Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    ready = _prepared(docs, key, text)
    counts = stored(corpus_counts(ready, depth), "counts")
    words = counts.where(F.col("kind") == WORDS)
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    scale = math.log10(total + 0.5 * (distinct + 1))
    word_logs = words.select("kind", "item", "n", (F.log10(F.col("n") + 0.5) - scale).alias("value"))
    model = stored(word_logs.unionAll(gram_model(counts, depth).select(F.lit(GRAMS).alias("kind"), "item", "n", "value")), "model")
    unseen = math.log10(0.5) - scale

    heads = {}
    for kind, most in ((WORDS, HEAD_WORDS), (GRAMS, HEAD_GRAMS)):
        top = model.where(F.col("kind") == kind).orderBy(F.col("n").desc(), "item").limit(most).select("item", "n", "value").toArrow()
        items = top.column("item").to_numpy().view(np.uint64)
        order = np.argsort(items)
        heads[kind] = (items[order], top.column("value").to_numpy()[order], (top.column("n").to_numpy() > 0)[order])
        del top
    shared = spark.sparkContext.broadcast(heads)
    kind_of_id = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_heads = shared.value

        def looked_up(kind: int, items: np.ndarray, doc: np.ndarray, size: int):
            """Per text the sum of logs and the number of known items of the head; and (text, item, n) of the rest."""
            keys, values, seen = known_heads[kind]
            unique, place = np.unique(items, return_inverse=True)
            at = np.minimum(np.searchsorted(keys, unique), max(len(keys) - 1, 0))
            hit = keys[at] == unique if len(keys) else np.zeros(len(unique), bool)
            logs = np.where(hit, values[at], 0.0) if len(keys) else np.zeros(len(unique))
            fresh = hit & seen[at] if len(keys) else hit
            sums = np.bincount(doc, weights=logs[place], minlength=size).astype(float)    # of nothing it makes integers
            known = np.bincount(doc, weights=fresh[place], minlength=size).astype(np.int64)
            rest = ~hit[place]
            pair, n = np.unique((doc[rest].astype(np.uint64) << np.uint64(32)) | place[rest].astype(np.uint64), return_counts=True)
            return sums, known, ((pair >> np.uint64(32)).astype(np.int64), unique[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)], n)

        for batch in slices(batches, 1, SLICE_BYTES):
            raw, offsets = joined_bytes(batch.column(1))
            raw, size = LOWER_BYTES[raw], batch.num_rows
            words_, doc = tokens_of(raw, offsets)
            n_tokens = np.bincount(doc, minlength=size)
            base, known, tail_words = looked_up(WORDS, words_, doc, size)
            score, _, tail_grams = looked_up(GRAMS, *gram_codes(raw, offsets, depth), size)
            row = batch.column(3).to_numpy()
            doc = np.concatenate([np.arange(size), tail_words[0], tail_grams[0]])
            a, b = len(tail_words[0]), len(tail_grams[0])
            more = a + b
            fill = lambda x: pa.array(np.concatenate([x, np.zeros(more, x.dtype)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), batch.column(2).take(pa.array(doc)), pa.array(row[doc]),
                 pa.array(np.concatenate([np.full(size, SUMMARY), np.full(a, WORDS), np.full(b, GRAMS)]).astype(np.int32)),
                 pa.array(np.concatenate([row, tail_words[1].view(np.int64), tail_grams[1].view(np.int64)])),
                 pa.array(np.concatenate([np.zeros(size, np.int64), tail_words[2], tail_grams[2]])),
                 fill(n_tokens.astype(np.int64)), fill(np.diff(offsets).astype(np.int64)), fill(known), fill(base), fill(score)],
                ["doc_id", "held_out", "row", "kind", "item", "times", "n_tokens", "n_bytes", "known", "base", "score"])

    rows = ready.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        run, f"doc_id {kind_of_id}, held_out boolean, row bigint, kind int, item bigint, times bigint, n_tokens bigint, n_bytes bigint, "
             "known bigint, base double, score double")
    met = rows.join(model.select("kind", "item", "n", "value"), ["kind", "item"], "left")
    is_word, is_gram = F.col("kind") == WORDS, F.col("kind") == GRAMS
    summed = met.groupBy("row", "doc_id", "held_out").agg(
        F.sum("n_tokens").alias("n_tokens"), F.sum("n_bytes").alias("n_bytes"),
        F.sum(F.col("known") + F.when(is_word & (F.col("n") > 0), F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(is_word, F.col("times") * F.coalesce("value", F.lit(unseen))).otherwise(0.0)).alias("base_score"),
        F.sum(F.col("score") + F.when(is_gram, F.col("times") * F.col("value")).otherwise(0.0)).alias("score"))
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * F.lit(math.log2(10.0)) / F.col("n_bytes")).otherwise(0.0)
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("bigint").alias("train_tokens"), "base_score", "score",
                         bits.alias("bits_per_byte"))
