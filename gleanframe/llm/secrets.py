"""Secret scans: fixed patterns, and automata inferred from the credentials that the patterns label."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices, stored, texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = 16
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "inferred")
PLAIN = "plain"
#: Signs by class: what a format fixes is which classes follow one another, not which letters.
CLASSES = str.maketrans({**dict.fromkeys("abcdef", "h"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "z"),
                         **dict.fromkeys("ABCDEF", "H"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "Z"),
                         **dict.fromkeys("0123456789", "0")})


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of the fixed patterns, leftmost and non-overlapping per kind."""
    found = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(k in low for k in KEYWORDS):
        found += [(*m.span(), "assign", m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        found += [(*m.span(), "access", m.group()) for m in ACCESS.finditer(text) if len(m.group()) >= 18]
    return found


def scan(text: str) -> tuple[list[tuple[int, int, str, str]], list[tuple[int, int, str]]]:
    """Spans of the fixed patterns, and the candidates: what these leave of the runs of credential signs, if long enough."""
    found, runs = base_spans(text), [(*m.span(), m.group()) for m in CANDIDATE.finditer(text)]
    for a, b, _ in runs:                                 # hex signs are credential signs: no hex run outside a candidate
        found += [(*m.span(), "hex", m.group()) for m in HEX.finditer(text, a, b)]
    taken = sorted((a, b) for a, b, _, _ in found)
    free, i, done = [], 0, 0                             # no sign before ``done`` is free
    for a, b, _ in runs:
        done = max(done, a)
        while i < len(taken) and taken[i][0] < b:
            x, y = taken[i]
            if x - done >= LEAST:
                free.append((done, x, text[done:x]))
            done = max(done, y)
            i += 1
        if b - done >= LEAST:
            free.append((done, b, text[done:b]))
    return found, free


class Automaton:
    """A probabilistic automaton inferred from weighted strings by merging compatible prefix-tree states."""

    FLOOR = math.log(1e-4)

    def __init__(self, sample: list[tuple[str, int]], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.through: list[dict[str, int]] = [{}]
        self.visits, self.ends = [0], [0]
        for string, weight in sample:
            self._insert(string, weight)
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()
        self.logs = [{s: math.log(n / v) for s, n in out.items()} if v else {} for out, v in zip(self.through, self.visits)]
        self.end_logs = [math.log(e / v) if e and v else self.FLOOR for e, v in zip(self.ends, self.visits)]

    def _insert(self, string: str, weight: int) -> None:
        state = 0
        for sign in string:
            self.visits[state] += weight
            self.through[state][sign] = self.through[state].get(sign, 0) + weight
            if sign not in self.next[state]:
                self.next[state][sign] = len(self.next)
                self.next.append({})
                self.through.append({})
                self.visits.append(0)
                self.ends.append(0)
            state = self.next[state][sign]
        self.visits[state] += weight
        self.ends[state] += weight

    def _close(self, a: int, n: int, b: int, m: int) -> bool:
        """Hoeffding's test of two relative frequencies."""
        return abs(a / n - b / m) < self.bound * (n ** -0.5 + m ** -0.5) if n and m else True

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = self.visits[p], self.visits[q]
            if not self._close(self.ends[p], n, self.ends[q], m):
                return False
            for sign in self.through[p].keys() | self.through[q].keys():
                if not self._close(self.through[p].get(sign, 0), n, self.through[q].get(sign, 0), m):
                    return False
            todo += [(self.next[p][s], self.next[q][s]) for s in self.next[p].keys() & self.next[q].keys()]
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the tree below q to the states from p on."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.visits[p] += self.visits[q]
            self.ends[p] += self.ends[q]
            for sign, n in self.through[q].items():
                self.through[p][sign] = self.through[p].get(sign, 0) + n
                if sign in self.next[p]:
                    todo.append((self.next[p][sign], self.next[q][sign]))
                else:
                    self.next[p][sign] = self.next[q][sign]

    def _merge_states(self) -> None:
        red = [0]
        fringe = [(0, s) for s in sorted(self.next[0])]
        while fringe:
            parent, sign = fringe.pop(0)
            blue = self.next[parent][sign]
            if blue in red:
                continue
            partner = next((r for r in red if self._compatible(r, blue)), None)
            if partner is None:
                red.append(blue)
                fringe += [(blue, s) for s in sorted(self.next[blue])]
            else:
                self.next[parent][sign] = partner
                self._fold(partner, blue)
                known = set(fringe)
                fringe += [(r, s) for r in red for s in sorted(self.next[r])
                           if self.next[r][s] not in red and (r, s) not in known]

    def log_likelihood(self, string: str) -> float:
        """Natural log probability per sign, the end counting as one; what was never seen has a floor."""
        state, total = 0, 0.0
        for sign in string:
            step = self.logs[state].get(sign)
            if step is None:
                total += self.FLOOR
                state = 0                                       # start anew after what the format doesn't know
                continue
            total += step
            state = self.next[state][sign]
        return (total + self.end_logs[state]) / (len(string) + 1)


class Formats:
    """One automaton per kind of labelled credential, one for plain runs, and the likelihoods that decide."""

    def __init__(self, samples: dict[str, list[tuple[str, int]]], margin: float = 0.3):
        self.margin = margin
        self.plain = Automaton(samples[PLAIN]) if samples.get(PLAIN) else None
        self.kinds = {k: Automaton(rows) for k, rows in sorted(samples.items()) if k != PLAIN and rows}
        # a format's own credentials score at least this, but for the odd one in fifty
        self.least = {k: float(np.quantile([a.log_likelihood(s) for s, _ in samples[k]], 0.02)) for k, a in self.kinds.items()}
        self.known: dict[str, bool] = {}

    def secret(self, value: str) -> bool:
        shape = value.translate(CLASSES)
        if shape not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            against = self.plain.log_likelihood(shape) if self.plain else Automaton.FLOOR
            self.known[shape] = any(score >= self.least[k] and score - against >= self.margin
                                    for k, a in self.kinds.items() for score in [a.log_likelihood(shape)])
        return self.known[shape]


def labelled_shapes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, shape, n) of all credentials the patterns find and of all other candidate runs, over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            counts: dict[tuple[str, str], int] = {}
            for t in texts(batch.column(0)):
                found, free = scan(t)
                for kind, value in [(k, v) for _, _, k, v in found] + [(PLAIN, v) for _, _, v in free]:
                    key = (kind, value.translate(CLASSES))
                    counts[key] = counts.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in counts], pa.string()), pa.array([s for _, s in counts], pa.string()),
                                              pa.array(list(counts.values()), pa.int64())], ["kind", "shape", "n"])

    rows = docs.select(text).mapInArrow(run, "kind string, shape string, n bigint")
    return rows.groupBy("kind", "shape").agg(F.sum("n").alias("n"))


def infer_formats(docs: DataFrame, text: str = "text", bound: int = 2_000, longest: int = 400) -> Formats:
    """Automata from at most ``bound`` shapes of each kind (in hash order, with their counts over all documents).

    Shapes of over ``longest`` signs take no part in training; they are scored like all others.
    """
    shapes = stored(labelled_shapes(docs, text).where(F.length("shape") <= longest).withColumn("_hash", F.xxhash64("shape")), "shapes")
    picked = None
    for kind in (*KINDS[:3], PLAIN):
        part = shapes.where(F.col("kind") == kind).orderBy("_hash", "shape").limit(bound).select("kind", "shape", "n")
        picked = part if picked is None else picked.unionAll(part)
    samples: dict[str, list[tuple[str, int]]] = {}
    for kind, shape, n in picked.collect():
        samples.setdefault(kind, []).append((shape, int(n)))
    return Formats({k: sorted(v) for k, v in samples.items()})


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", formats: Formats | None = None) -> DataFrame:
    """key, n_assign, n_access, n_hex, base_spans, spans of every document: ``kind:start:end`` in code points.

    The fixed patterns' spans stay; runs that an inferred format makes likelier than plain text by ``margin`` are
    added as ``inferred``.  Null text counts as empty and has no spans; copies get the same spans; columns other than
    key and text are not looked at.
    """
    judge = formats or infer_formats(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = []
            for t in texts(batch.column(1)):
                found, free = scan(t)
                base = [(a, b, k) for a, b, k, _ in found]
                more = [(a, b, "inferred") for a, b, v in free if judge.secret(v)]
                kinds = [k for _, _, k in base]
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), _joined(base), _joined(base + more)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 3 + [pa.string()] * 2)]],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string")


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", formats: Formats | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans by one); null texts stay null; all rows stay."""
    judge, names = formats or infer_formats(docs, text), list(docs.columns)
    position = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, position):
            out = []
            for t in batch.column(position).to_pylist():
                if t:
                    found, free = scan(t)
                    done, parts = 0, []
                    for a, b in sorted([(a, b) for a, b, _, _ in found] + [(a, b) for a, b, v in free if judge.secret(v)]):
                        if a >= done:
                            parts += [t[done:a], mark]
                        done = max(done, b)
                    t = "".join(parts) + t[done:]
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == position else c for i, c in enumerate(batch.columns)],
                                             names=names)

    done = docs.mapInArrow(run, docs.schema)
    return done.withColumn("n_chars", F.length(text).cast("bigint")) if "n_chars" in docs.columns else done

