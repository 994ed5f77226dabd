"""SentencePiece models run by the tokenizers library."""

from __future__ import annotations

import hashlib
import os
import re
import struct
import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import handing_back, slices, texts

MARK = "▁"
ENTRY = 250                                                            # bytes of a remembered word beside its signs and ids
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6       # piece kinds of the model format
UNIGRAM, BPE = 1, 2                                                    # model kinds of the model format
#: Where the library looks for a model unless told otherwise.
MODEL_VARIABLE, DEFAULT_MODEL = "GLEANFRAME_SENTENCEPIECE", "/opt/tokenizers/piece_bpe_32k.model"


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each protobuf field: ints, 4- or 8-byte strings, or byte strings."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(wire)
        if size is None:
            if wire != 2:
                raise ValueError(f"wire type {wire} in a model file")
            size = varint()
        yield key >> 3, data[at:at + size]
        at += size


@dataclass
class Model:
    """What a model file says; field numbers are those of the public model format."""
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, data: bytes) -> "Model":
        out = cls()
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode("utf-8")
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                out.pieces.append((piece, score, kind))
            elif number == 2:
                for n, v in _fields(value):
                    if n == 3:
                        out.kind = v
                    elif n == 35:
                        out.byte_fallback = bool(v)
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        out.charsmap = v
                    elif n in (3, 4, 5):
                        setattr(out, {3: "dummy_prefix", 4: "squeeze", 5: "escape"}[n], bool(v))
        return out

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @property
    def words_stand_alone(self) -> bool:
        """No piece reaches from one word into the next: a run of marks and the word behind it can be encoded alone."""
        return not any(kind in (NORMAL, USER) and MARK in piece.lstrip(MARK) for piece, _, kind in self.pieces)


def merges_of(model: Model) -> list[tuple[str, str]]:
    """Every way to join two pieces into a third, best score of the result first, as byte-pair encoding ranks them."""
    place = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
    found = []
    for piece, i in place.items():
        for cut in range(1, len(piece)):
            left, right = place.get(piece[:cut]), place.get(piece[cut:])
            if left is not None and right is not None:
                found.append((-model.pieces[i][1], i, left, right, piece[:cut], piece[cut:]))
    return [(f[4], f[5]) for f in sorted(found)]


def backend(model: Model):
    """The tokenizers-library twin of a model: normaliser, marker, scores or merges, byte fallback, decoder."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if any(kind == USER for _, _, kind in model.pieces):
        raise ValueError("models with user-defined symbols are not supported")
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unknown, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, merges_of(model),
                          unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and byte-pair models are supported")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(),
                                     *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return out


class Codec:
    """Encodes batches; words are encoded by the library's threads, checked against SentencePiece and remembered, in
    ``remember`` bytes and what one batch adds."""

    def __init__(self, data: bytes, threads: int = 2, verify: bool = True, remember: int = 48 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        self.model, self.remember, self.verify = Model.parse(data), remember, verify
        self.tokenizer = backend(self.model)
        self.normalizer, self.tokenizer.normalizer = self.tokenizer.normalizer, _nothing()
        self.word = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.known: dict[str, tuple[bytes, bool]] = {}
        self.held = 0                                       # bytes of what is known, about
        self.plain = not self.model.charsmap and not self.model.squeeze and self.model.escape
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else
                         " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode()
                         for p, _, kind in self.model.pieces]
        self.is_byte = np.array([kind == BYTE for _, _, kind in self.model.pieces])
        if verify:
            import sentencepiece
            self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)

    def normalised(self, text: str) -> str:
        if self.plain:
            return ((MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)) if text else ""
        return self.normalizer.normalize_str(text) if text else ""

    def _agrees(self, words: list[str], ids: list[list[int]]) -> list[bool]:
        """Encoding and decoding by SentencePiece itself give the same ids and the same text."""
        if not self.verify:
            return [True] * len(words)
        prefix = self.model.dummy_prefix
        alone = [w[1:].replace(MARK, " ") if prefix and w[0] == MARK else w.replace(MARK, " ") for w in words]
        theirs = self.reference.encode(alone, num_threads=1)
        back = self.reference.decode(theirs, num_threads=1)
        table = self.bytes_of
        ours = [b"".join([table[i] for i in word]) for word in ids]
        skip = 1 if prefix else 0
        same = [a == b and x.encode() == y[skip:] for a, b, x, y in zip(ids, theirs, back, ours)]
        # a marker alone (a space at the end) cannot be given to SentencePiece as a text of its own
        return [ok or (w == MARK and prefix and i == [self.reference.piece_to_id(MARK)]) for ok, w, i in zip(same, words, ids)]

    def learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 50_000):
            part = words[at:at + 50_000]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            for w, i, same in zip(part, ids, self._agrees(part, ids)):
                self.known[w] = (np.array(i, np.int32).tobytes(), same)
                self.held += ENTRY + 2 * len(w) + 4 * len(i)

    def encode(self, batch: list[str]) -> list[tuple[np.ndarray, bool]]:
        """(ids, parity) of each text."""
        ready = [self.normalised(t) for t in batch]
        split = [self.word.findall(t) for t in ready] if self.model.words_stand_alone else [[t] if t else [] for t in ready]
        fresh = set().union(*split) if split else set()
        if self.held > self.remember:
            self.known.clear()
            self.held = 0
        self.learn(sorted(fresh - self.known.keys()))
        known, out = self.known, []
        for words in split:
            found = [known[w] for w in words]
            out.append((np.frombuffer(b"".join([f[0] for f in found]), np.int32), all([f[1] for f in found])))
        return out

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes_of
        text = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def worker_codec(data: bytes, threads: int = 2, verify: bool = True) -> Codec:
    """The codec of this Python process, which serves many tasks; tasks have their own copies of this module."""
    kept = sys.modules.setdefault("_gleanframe_codecs", types.ModuleType("_gleanframe_codecs")).__dict__
    key = f"{hashlib.sha256(data).hexdigest()} {threads} {verify}"
    if key not in kept:
        kept[key] = Codec(data, threads, verify)
    return kept[key]


def _nothing():
    from tokenizers import normalizers
    return normalizers.Sequence([])


def model_path(path: str | None = None) -> str:
    return path or os.environ.get(MODEL_VARIABLE, DEFAULT_MODEL)


def _model_bytes(path: str | None) -> bytes:
    with open(model_path(path), "rb") as f:
        return f.read()


def encode(df: DataFrame, text: str = "text", path: str | None = None, threads: int = 2) -> DataFrame:
    """``df`` with ``ids`` (array of int); whole texts, null as the empty text, which has no ids; a column ``ids`` that
    is there is replaced, repeated rows are encoded each, an empty table stays empty.

    The model file is read on the driver and sent to the tasks; it is a fixed file, not a function of the data.
    """
    df = df.drop("ids")
    data, names = _model_bytes(path), list(df.columns)
    position = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(data, threads)
        for batch in slices(batches, position):
            found = [ids for ids, _ in codec.encode(texts(batch.column(position)))]
            ends = np.concatenate([[0], np.cumsum([len(i) for i in found])])
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                                             names=[*names, "ids"])

    return df.mapInArrow(handing_back(run), f"{_ddl(df)}, ids array<int>")


def decode(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with ``decoded``, the text of its ids; null ids give the empty text."""
    df = df.drop("decoded")
    data, names = _model_bytes(path), list(df.columns)
    position = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(data, 1, verify=False)
        for batch in batches:
            out = [codec.decode(np.array(i or [], np.int32)) for i in batch.column(position).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*names, "decoded"])

    return df.mapInArrow(run, f"{_ddl(df)}, decoded string")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encode_summaries(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
                     threads: int = 2) -> DataFrame:
    """Encode and decode every text and return what can be checked of it.

    key, n_tokens, n_byte_tokens, ids_sha256 (ids as little-endian 32-bit integers), decoded_sha256, round_trip (the
    decoded text is the text itself), parity (every distinct word gives the ids and the text that SentencePiece
    gives).  Null texts count as empty: no tokens, digests of nothing, true and true.
    """
    data = _model_bytes(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(data, threads)
        for batch in slices(batches, 1):
            batch_texts = texts(batch.column(1))
            rows = []
            for t, (ids, same) in zip(batch_texts, codec.encode(batch_texts)):
                back = codec.decode(ids)
                rows.append((len(ids), int(codec.is_byte[ids].sum()), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(),
                             hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == t, same))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*rows))],
                                             ["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "decoded_sha256", "round_trip", "parity"])

    return df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        handing_back(run), f"doc_id {df.schema[key].dataType.simpleString()}, n_tokens bigint, n_byte_tokens bigint, ids_sha256 string, "
             "decoded_sha256 string, round_trip boolean, parity boolean")
