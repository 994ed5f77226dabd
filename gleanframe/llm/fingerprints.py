"""Document fingerprints: content-defined chunks by a normalised gear hash, compared by weighted containment."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mixed, slices

WINDOW = 32                        # bytes that a gear hash sees
LEAST, NORMAL, MOST = 32, 64, 256  # chunk sizes in bytes; no chunk is cut before the hash has left the one before
STRICT, LOOSE = 24, 28             # a cut needs the 8 top bits to be zero before the normal size, 4 after it


class Chunker:
    """Cuts many texts at once; a text's chunks depend on its own bytes only."""

    def __init__(self):
        self.gear = (mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
        self.base = np.uint64(0x9E3779B97F4A7C15)                       # odd, so it has an inverse modulo 2**64
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        ones = np.full(n, self.base, np.uint64)
        ones[0] = 1
        self.powers = np.cumprod(ones)
        ones[1:] = self.inverse
        self.back = np.cumprod(ones)

    def __call__(self, parts: list[bytes]) -> list[np.ndarray]:
        """For each text its set of (digest, length), sorted."""
        kind = np.dtype([("digest", ">u4"), ("length", ">u2")])
        raw = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        if not len(raw):
            return [np.zeros(0, kind) for _ in parts]
        if len(raw) + 1 > len(self.powers):
            self._grow(max(len(raw) + 1, 2 * len(self.powers)))
        h = self.gear[raw]
        step = 1
        while step < WINDOW:
            more = h.copy()
            more[step:] += h[:-step] << np.uint32(step)
            h, step = more, step * 2
        loose = np.flatnonzero(h >> np.uint32(LOOSE) == 0)
        strict = loose[h[loose] >> np.uint32(STRICT) == 0]
        far = np.array([len(raw) + MOST + 1])
        loose, strict = np.concatenate([loose, far]), np.concatenate([strict, far])
        doc = np.flatnonzero(np.diff(np.concatenate([[0], ends])) > 0)
        start, stop = np.concatenate([[0], ends[:-1]])[doc], ends[doc]
        cuts = []
        while len(doc):
            p = strict[np.searchsorted(strict, start + LEAST - 1)]
            q = loose[np.searchsorted(loose, start + NORMAL - 1)]
            cut = np.where(p < start + NORMAL - 1, p + 1, np.minimum(q + 1, start + MOST))
            cut = np.minimum(cut, stop)
            cuts.append((doc, start, cut))
            on = cut < stop
            doc, start, stop = doc[on], cut[on], stop[on]
        doc, start, cut = (np.concatenate(c) for c in zip(*cuts))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[:len(raw)])])
        digest = mixed((sums[cut] - sums[start]) * self.back[start] + (cut - start).astype(np.uint64)) >> np.uint64(32)
        key = (doc.astype(np.uint64) << np.uint64(32)) | digest
        key, first = np.unique(key, return_index=True)
        out = np.empty(len(key), kind)
        out["digest"], out["length"] = key & np.uint64(0xFFFFFFFF), (cut - start)[first]
        bounds = np.searchsorted((key >> np.uint64(32)).astype(np.int64), np.arange(len(parts) + 1))
        return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's chunk bytes whose chunks b has as well; 1 if both are empty, 0 if only a is."""
    if not len(a):
        return 0.0 if len(b) else 1.0
    total = int(a["length"].astype(np.int64).sum())
    return float(a["length"][np.isin(a["digest"], b["digest"])].astype(np.int64).sum()) / total


def written(f: np.ndarray) -> str:
    """12 hexadecimal digits per chunk: digest and length."""
    return f.tobytes().hex()


def read_back(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), np.dtype([("digest", ">u4"), ("length", ">u2")]))


def fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``fingerprint``; null texts count as empty and have the empty fingerprint."""
    position, rest = df.columns.index(text), [c for c in df.columns if c != "fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = Chunker()
        for batch in slices(batches, position):
            found = [written(f) for f in chunker([(t or "").encode() for t in batch.column(position).to_pylist()])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(found, pa.string())], names=[*rest, "fingerprint"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "fingerprint")
    return df.mapInArrow(run, f"{fields}, fingerprint string")


RESULT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def edited_likeness(docs: DataFrame, bucket_bytes: int = 16 << 20, most_buckets: int = 10_000) -> DataFrame:
    """Each document against itself with its second half replaced by the beginning of the next one (descending id).

    Texts are shuffled once: ids are cut into ranges, and the document with a range's largest id also goes, as a
    guest, to the range above, so that every range can be read in order with the next document at hand.  Null ids
    come after all others; equal ids stand in the order of their texts; null texts count as empty.
    """
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, size, top = base.agg(F.count("*"), F.sum(F.octet_length("text")), F.max("doc_id")).first()
    count = int(min(max((size or 0) // bucket_bytes, 1), most_buckets))
    cuts = []
    if count > 1 and top is not None:
        shares = [(i + 1) / count for i in range(count - 1)]
        cuts = base.agg(F.percentile_approx("doc_id", shares, 100 * count)).first()[0]
    tops = np.array(sorted({*cuts, top}) if top is not None else [], np.int64)   # largest id of each range

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            absent = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            known = np.where(absent, 0, np.nan_to_num(ids)).astype(np.int64) if absent.any() else ids.astype(np.int64)
            bucket = np.where(absent, 0, np.searchsorted(tops, known)) if len(tops) else np.zeros(len(ids), np.int64)
            guests = np.flatnonzero(~absent & np.isin(known, tops))
            above = (bucket[guests] + 1) % max(len(tops), 1)                     # the lowest range goes on with the highest id
            take = pa.array(np.concatenate([np.arange(len(ids)), guests]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate([bucket, above]).astype(np.int64)),
                 pa.array(np.concatenate([np.zeros(len(ids), np.int32), np.ones(len(guests), np.int32)]))],
                ["doc_id", "text", "bucket", "guest"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = Chunker()

        def rows(run: list[tuple]) -> pa.RecordBatch:
            """All of run but its last row, which only serves as the next document."""
            kept = []
            for (bucket, guest, doc, text), (_, _, _, following) in zip(run, run[1:]):
                half = len(text) // 2
                kept.append((doc, text, text[:len(text) - half] + following[:half]))
            own = chunker([r[3].encode() for r in run])
            edited = chunker([k[2].encode() for k in kept])
            out = [(doc, len(text), hashlib.sha256(new.encode()).hexdigest(), written(own[i]), written(edited[i]),
                    containment(own[i], edited[i]), containment(own[i], own[i + 1])) for i, (doc, text, new) in enumerate(kept)]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names)

        held: list[tuple] = []
        first: tuple | None = None
        for batch in slices(batches, 1, 2 << 20):
            for row in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and held[-1][0] != row[0]:                                # a new range
                    yield rows(held if held[-1][1] else [*held, first])
                    held = []
                if not held:
                    first = row
                if held and held[-1][1]:
                    continue                                                      # a further guest of the same id
                held.append(row)
            if len(held) > 1:
                yield rows(held)
                held = held[-1:]
        if held and not held[-1][1]:
            yield rows([*held, first])

    dealt = base.mapInArrow(deal, "doc_id bigint, text string, bucket bigint, guest int")
    placed = (dealt.repartition(F.col("bucket"))
              .sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text"))
    return placed.mapInArrow(compare, RESULT)
