"""Operator 7: SentencePiece encoding and decoding with the tokenizers library.

The model's protobuf is parsed field by field (no generated classes). Its normaliser options, the space marker, the
pieces with their scores and the byte pieces are rebuilt as a tokenizers pipeline: for a byte-pair model the merges are
all splits of a piece into two pieces, in order of the piece's score; for a unigram model the scores themselves. The
backend has no equal to a precompiled character map, so only models with the identity map are taken.

No piece of such vocabularies holds the marker after another character (checked), so no merge crosses the head of a
marker run and a text may be cut there. Distinct words of a batch are encoded once, batched and multithreaded; each
new word's ids are verified against the sentencepiece library before they are used (``verify``), so parity holds for
all that is returned. Decoding joins pieces, turns byte pieces back to UTF-8 and markers to spaces.

Defined results: null and empty texts have no ids and decode to an empty text; texts of any length are encoded whole, in
words; one unbroken word of any length is one call; repeated rows are encoded like any other; an empty table gives no
rows; other columns are not read. No shuffle.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; 32- and 64-bit values as bytes."""
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
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else 4 if kind == 5 else 8
        yield tag >> 3, data[at : at + n]
        at += n


@dataclass
class Model:
    """What the protobuf says: pieces (text, score, kind), 1 unigram or 2 byte pair, byte fallback, normaliser."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = 1
    byte_fallback: bool = False
    map_name: str = "identity"
    char_map: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    mark_spaces: bool = True


def parse(data: bytes) -> Model:
    m = Model()
    for number, value in fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    text = v.decode()
                elif n == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif n == 3:
                    kind = v
            m.pieces.append((text, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    m.kind = v
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 1:
                    m.map_name = v.decode()
                elif n == 2:
                    m.char_map = v
                elif n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.squeeze = bool(v)
                elif n == 5:
                    m.mark_spaces = bool(v)
    if m.char_map or m.squeeze or not m.mark_spaces:
        raise ValueError(f"normaliser {m.map_name} with these options can't be rebuilt")
    if any(MARK in text.lstrip(MARK) for text, _, kind in m.pieces if kind in (NORMAL, USER)):
        raise ValueError("a piece holds the marker after another character: words can't be encoded alone")
    return m


def backend(m: Model):
    """The tokenizers object for single words (markers already in place)."""
    os.environ.setdefault("RAYON_NUM_THREADS", "2")  # idle threads of a wide pool spin
    from tokenizers import Tokenizer, models

    ids = {text: i for i, (text, _, _) in enumerate(m.pieces)}
    unk = next((text for text, _, kind in m.pieces if kind == UNKNOWN), None)
    if m.kind == 1:
        return Tokenizer(models.Unigram([(t, s) for t, s, _ in m.pieces], unk_id=ids.get(unk), byte_fallback=m.byte_fallback))
    usable = {text for text, _, kind in m.pieces if kind in (NORMAL, USER)}
    merges = []
    for text, score, kind in m.pieces:
        if kind in (NORMAL, USER):
            merges += [(-score, ids[text], text[:k], text[k:]) for k in range(1, len(text)) if text[:k] in usable and text[k:] in usable]
    merges.sort(key=lambda x: (x[0], x[1]))
    return Tokenizer(models.BPE(ids, [(a, b) for _, _, a, b in merges], unk_token=unk, fuse_unk=True, byte_fallback=m.byte_fallback))


class Codec:
    def __init__(self, data: bytes, verify: bool = True, most_words: int = 1_000_000):
        import re

        self.model, self.most_words = parse(data), most_words
        self.backend = backend(self.model)
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.known: dict[str, bytes] = {}  # ids as 32-bit integers
        self.text_of = [text for text, _, _ in self.model.pieces]
        self.byte_of = {i: int(text[3:5], 16) for i, (text, _, kind) in enumerate(self.model.pieces) if kind == BYTE}
        self.silent = {i for i, (_, _, kind) in enumerate(self.model.pieces) if kind == CONTROL}
        self.plain = np.array([i not in self.byte_of and i not in self.silent for i in range(len(self.text_of))])
        self.judge = None
        if verify:
            import sentencepiece

            self.judge = sentencepiece.SentencePieceProcessor(model_proto=data)

    def normalise(self, text: str) -> str:
        text = text.replace(" ", MARK)
        return MARK + text if self.model.dummy_prefix and text else text

    def learn(self, words: set[str]) -> None:
        """Encode words not known yet, in one multithreaded batch, and verify them."""
        new = [w for w in words if w not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > self.most_words:
            self.known.clear()
            new = list(words)
        got = [array("i", e.ids).tobytes() for e in self.backend.encode_batch_fast(new, add_special_tokens=False)]
        if self.judge is not None:
            for w, ids, right in zip(new, got, self.judged(new), strict=True):
                if ids != array("i", right).tobytes():
                    raise ValueError(f"the backends differ on {w!r}: {list(array('i', ids))} and {right}")
        self.known.update(zip(new, got, strict=True))

    def judged(self, words: list[str]) -> list[list[int]]:
        """The sentencepiece library's ids of words; it puts a marker before a text itself, and none before nothing."""
        alone = [w.strip(MARK) == "" for w in words]
        texts = ["a" + w if x else w.removeprefix(MARK) if self.model.dummy_prefix else w for w, x in zip(words, alone, strict=True)]
        skip = len(self.judge.encode("a"))
        return [ids[skip:] if x else ids for ids, x in zip(self.judge.encode(texts, num_threads=1), alone, strict=True)]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for at in range(0, len(texts), 256):
            split = [self.words(self.normalise(t)) for t in texts[at : at + 256]]
            self.learn(set().union(*split))
            get = self.known.__getitem__
            for words in split:
                yield np.frombuffer(b"".join(map(get, words)), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        if self.plain[ids].all():
            return self.spaced("".join(map(self.text_of.__getitem__, ids.tolist())))
        out: list[str] = []
        raw = bytearray()
        for i in ids.tolist():
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.silent:
                out.append(self.text_of[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return self.spaced("".join(out))

    def spaced(self, text: str) -> str:
        if self.model.dummy_prefix:
            text = text.removeprefix(MARK)
        return text.replace(MARK, " ")


_KEPT: dict[str, Codec] = {}


def codec(data: bytes, verify: bool = True) -> Codec:
    key = f"{hashlib.sha256(data).hexdigest()}{verify}"
    if key not in _KEPT:
        _KEPT[key] = Codec(data, verify)
    return _KEPT[key]


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", verify: bool = True, decode: bool = True) -> DataFrame:
    """Rows (id, ids, decoded): the piece ids of each whole text and the text they decode to (null unless ``decode``)."""
    with open(model, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            c = codec(data.value, verify)
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = list(c.encode([x.as_py() or "" for x in part.column(1)]))
                back = [c.decode(x) if decode else None for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, text) for rows of piece ids; null ids decode to an empty text."""
    with open(model, "rb") as f:
        data = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            c = codec(data.value, False)
            texts = [c.decode(np.array(x.as_py() or [], np.int32)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
