"""Operator 1: token counts by a compiled finite-state tokenizer.

The byte-pair vocabulary is compiled to a deterministic transducer over UTF-8 bytes. It rests on a property of
byte-pair encodings: a token sequence is the encoding of its text exactly if each neighbouring pair of tokens is
the encoding of the pair's own text. So every prefix of a word has one last token, found among the suffixes of the
prefix that start at a position whose own last token fits. A state holds, for each suffix of the word so far that
may still grow into a token, the last token before that suffix and the token count there relative to now; that is
all the future depends on, and there are finitely many such states. Each transition is annotated with the change of
the token count, so a sum along a path is the number of tokens. The word's end is a byte of its own (10, which
pre-tokenised text never holds) that leads back to the start state.

States are made on first use and kept in one table (next state and count in one integer), up to a bound; beyond it
the table is emptied and grows again, so memory is bounded whatever the text.

Text runs through the table in chunks, many at once. What a chunk does to a state that it starts in is a state map: the
state that it ends in and the tokens counted on the way. Only the chunk's head, the bytes up to its first word end, can
depend on the start (there may be too many states to write down the map for each of them), so ``StateMaps`` holds the
head's place, and what follows it: the count, and the end state. Maps of neighbouring chunks compose to a map of the
same form: the left one's end state decides what the right one's head counts. Composition is associative, so a parallel
prefix scan (``StateMaps.scan``: pairs are composed level by level, then the states go down the levels again, each level
at once) gives the state that every chunk starts in.

Null and empty texts have 0 tokens; a text of any length is processed whole; repeated rows are counted one by one.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import pieces

WORD_END = 10
ROOT, UNSYNCED = 0, 1


def byte_symbols() -> dict[str, int]:
    """The printable symbol that stands for each byte in byte-level vocabularies, and its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Spec:
    """What the transducer needs of a tokenizer file: word-end suffix, merges by rank, specials, pre-tokeniser pattern."""

    merges: dict[tuple[bytes, bytes], int]
    tokens: set[bytes]
    specials: list[str]
    pattern: str


def read_spec(data: bytes) -> Spec:
    """Read a tokenizers file of the kind: NFC, white space dropped, lower case, byte-level BPE with a word-end suffix."""
    d = json.loads(data)
    model, kinds = d["model"], [x["type"] for x in (d["normalizer"] or {}).get("normalizers", [])]
    split, level = d["pre_tokenizer"]["pretokenizers"]
    if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or level["type"] != "ByteLevel" or level["use_regex"] or not split["invert"]:
        raise ValueError("not a tokenizer of the kind that this compiler reads")
    end, byte_of = model["end_of_word_suffix"], byte_symbols()

    def raw(token: str) -> bytes:
        body = token.removesuffix(end)
        return bytes(byte_of[c] for c in body) + (b"\n" if body != token else b"")

    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
    specials = [x["content"] for x in d["added_tokens"]]
    tokens = {raw(t) for t in model["vocab"] if t not in set(specials)}
    return Spec(merges, tokens, specials, split["pattern"]["Regex"])


class Transducer:
    """The lazily built table; ``run`` and ``counts`` are what callers use."""

    def __init__(self, spec: Spec, max_states: int = 1 << 17):
        self.spec, self.max_states = spec, max_states
        self.growing = {t[:k] for t in spec.tokens for k in range(len(t))}
        self.fits: dict[tuple[bytes | None, bytes], bool] = {}
        self.start_over()

    def start_over(self) -> None:
        self.column = np.full(256, -1, np.int64)
        self.bytes_of: list[int] = []
        self.width = 64
        self.table = np.full((1024, self.width), -1, np.int32)
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.state_id(((0, None, 0),), b"")
        self.keys.append(("unsynced",))

    def state_id(self, entries: tuple, tail: bytes) -> int:
        key = (tail, entries)
        known = self.states.get(key)
        if known is None:
            known = self.states[key] = len(self.keys) if self.keys else 0
            self.keys.append(key)
            if known >= len(self.table):
                self.table = np.vstack([self.table, np.full(self.table.shape, -1, np.int32)])
        return known

    def encode(self, text: bytes) -> list[bytes]:
        """Plain byte-pair encoding of a short text, for the pairs that the compiler tests."""
        parts = [text[i : i + 1] for i in range(len(text))]
        if len(parts) > 1 and parts[-1] == b"\n":
            parts[-2:] = [parts[-2] + b"\n"]
        while len(parts) > 1:
            rank, at = min((self.spec.merges.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, before: bytes | None, token: bytes) -> bool:
        key = (before, token)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[key] = self.encode((before or b"") + token) == ([token] if before is None else [before, token])
        return known

    def compile(self, state: int, byte: int) -> None:
        """Fill one cell of the table."""
        col = int(self.column[byte])
        if state == UNSYNCED:
            self.table[state, col] = ((ROOT if byte == WORD_END else UNSYNCED) << 8) | 128
            return
        tail, entries = self.keys[state]
        c = bytes([byte])
        if byte == WORD_END and state == ROOT:
            self.table[state, col] = (ROOT << 8) | 128
            return
        for length, before, count in entries:
            token = tail[len(tail) - length :] + c
            if (byte != WORD_END or length) and token in self.spec.tokens and self.fit(before, token):
                change = count + 1
                break
        else:
            raise ValueError(f"no token of the vocabulary ends {tail + c!r}")
        if byte == WORD_END:
            self.table[state, col] = (ROOT << 8) | (change + 128)
            return
        kept = [(length + 1, before, n - change) for length, before, n in entries if tail[len(tail) - length :] + c in self.growing]
        grown = (*kept, (0, token, 0))
        longest = grown[0][0]
        new = self.state_id(grown, (tail + c)[len(tail) + 1 - longest :])
        self.table[state, col] = (new << 8) | (change + 128)

    def prepare(self, stream: np.ndarray) -> None:
        """Columns for all bytes of the stream; an over-full table is emptied first."""
        if len(self.keys) > self.max_states:
            self.start_over()
        for b in (*np.flatnonzero(np.bincount(stream, minlength=256)), WORD_END):
            if self.column[b] < 0:
                self.column[b] = len(self.bytes_of)
                self.bytes_of.append(int(b))
        if len(self.bytes_of) > self.width:
            wider = np.full((len(self.table), 256), -1, np.int32)
            wider[:, : self.width] = self.table
            self.table, self.width = wider, 256

    def step(self, states: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Table cells for many (state, column) pairs; missing ones are compiled."""
        cells = self.table.ravel().take(states * self.width + cols)
        if cells.min() < 0:
            for pair in np.unique((states * self.width + cols)[cells < 0]):
                self.compile(int(pair) // self.width, self.bytes_of[int(pair) % self.width])
            cells = self.table.ravel().take(states * self.width + cols)
        return cells

    def through(self, states: np.ndarray, cols: np.ndarray, start: np.ndarray, end: np.ndarray, out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Run spans of the columns, each from its state, all at once: end states and counts. ``out`` takes the change of
        the count at each place."""
        states, count, k = states.copy(), np.zeros(len(states), np.int64), 0
        here = np.flatnonzero(end > start)
        while len(here) > 4:
            at = start[here] + k
            cells = self.step(states[here], cols[at])
            states[here] = cells >> 8
            change = (cells & 255) - 128
            count[here] += change
            if out is not None:
                out[at] = change
            k += 1
            here = here[end[here] > start[here] + k]
        for i in here.tolist():  # few long spans: one after another
            state, total = int(states[i]), 0
            for at, col in enumerate(cols[start[i] + k : end[i]].tolist(), int(start[i]) + k):
                cell = int(self.table[state, col])
                if cell < 0:
                    self.compile(state, self.bytes_of[col])
                    cell = int(self.table[state, col])
                state, change = cell >> 8, (cell & 255) - 128
                total += change
                if out is not None:
                    out[at] = change
            states[i], count[i] = state, count[i] + total
        return states, count

    def run(self, stream: np.ndarray, lanes: int = 4096) -> np.ndarray:
        """Change of the token count at each byte of a stream that starts at a word's start."""
        n = len(stream)
        if not n:
            return np.zeros(0, np.int8)
        self.prepare(stream)
        lanes = max(1, min(lanes, n // 64))
        length = -(-n // lanes)
        cols = np.full(lanes * length, self.column[WORD_END], np.int64)
        cols[:n] = self.column[stream]
        by_step = np.ascontiguousarray(cols.reshape(lanes, length).T)
        changes = np.empty((length, lanes), np.int8)
        states = np.full(lanes, UNSYNCED, np.int64)  # until a chunk's first word end, exact from there on
        for k in range(length):
            cells = self.step(states, by_step[k])
            states = (cells >> 8).astype(np.int64)
            changes[k] = (cells & 255) - 128
        by_chunk = np.ascontiguousarray(changes.T)
        maps = StateMaps.of_chunks(self, cols, by_chunk, states)
        enter, _ = maps.scan(ROOT)
        out = by_chunk.reshape(-1)
        self.through(enter, cols, maps.start, maps.head, out)
        return out[:n]


@dataclass
class StateMaps:
    """What spans of the columns do to the state, one span a row: the bytes from ``start`` to ``head`` run from the state
    that the span starts in; after them ``count`` tokens follow, and the span ends in the state ``to``. Where ``to`` is
    UNSYNCED the span holds no word end: its head is all of it, and leads each state to one of its own."""

    machine: Transducer
    cols: np.ndarray
    start: np.ndarray
    head: np.ndarray
    count: np.ndarray
    to: np.ndarray

    @classmethod
    def of_chunks(cls, machine: Transducer, cols: np.ndarray, changes: np.ndarray, to: np.ndarray) -> StateMaps:
        """The maps of the chunks (rows of ``changes``), which were run from the state UNSYNCED and ended in ``to``."""
        lanes, length = changes.shape
        ends = cols.reshape(lanes, length) == machine.column[WORD_END]
        size = np.where(ends.any(1), ends.argmax(1) + 1, length)
        start = np.arange(lanes) * length
        after = np.arange(length) >= size[:, None]
        return cls(machine, cols, start, start + size, np.where(after, changes, 0).sum(1, dtype=np.int64), to.copy())

    def rows(self, which: slice | np.ndarray) -> StateMaps:
        return StateMaps(self.machine, self.cols, *(x[which] for x in (self.start, self.head, self.count, self.to)))

    def apply(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state that each span leads its state to, and the tokens on the way."""
        end, count = self.machine.through(states, self.cols, self.start, self.head)
        return np.where(self.to == UNSYNCED, end, self.to), count + self.count

    def compose(self, later: StateMaps) -> StateMaps:
        """Each span and the one of ``later`` that follows it, as one."""
        whole = self.to == UNSYNCED
        known = ~whole
        to, count = later.to.copy(), later.count.copy()
        if known.any():
            to[known], more = later.rows(known).apply(self.to[known])
            count[known] = self.count[known] + more
        return StateMaps(self.machine, self.cols, self.start, np.where(whole, later.head, self.head), count, to)

    def scan(self, state: int) -> tuple[np.ndarray, np.ndarray]:
        """The state before each span, and the tokens before it, if the first one starts in ``state``."""
        n = len(self.to)
        if n == 1:
            return np.array([state], np.int64), np.zeros(1, np.int64)
        left, right = self.rows(slice(0, n - 1, 2)), self.rows(slice(1, n, 2))
        pairs = left.compose(right)
        if n % 2:
            last = self.rows(slice(n - 1, n))
            pairs = StateMaps(self.machine, self.cols, *(np.concatenate([getattr(pairs, f), getattr(last, f)]) for f in ("start", "head", "count", "to")))
        states, counts = np.empty(n, np.int64), np.empty(n, np.int64)
        states[::2], counts[::2] = pairs.scan(state)
        k = len(left.to)
        states[1::2], more = left.apply(states[::2][:k])
        counts[1::2] = counts[::2][:k] + more
        return states, counts


class Counter:
    """Token counts of texts: pre-tokeniser, then the transducer over the words of many texts at once."""

    def __init__(self, data: bytes, max_states: int = 1 << 17):
        import regex

        spec = read_spec(data)
        self.machine = Transducer(spec, max_states)
        self.words = regex.compile(spec.pattern, regex.V0).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(spec.specials, key=len, reverse=True))) or "(?!)")
        self.marks = [s[:2] for s in spec.specials]

    def stream(self, text: str) -> tuple[str, int]:
        """The words of a text, each with its end, and the number of special tokens in it."""
        n, parts = 0, [text]
        if any(m in text for m in self.marks):
            parts = self.special.split(text)
            n = len(parts) - 1
        out = []
        for x in parts:
            if not x.isascii():
                if not unicodedata.is_normalized("NFC", x):
                    x = unicodedata.normalize("NFC", x)
                x = x.replace("Σ", "σ")  # lower() alone would make a final sigma of some
            words = self.words(x.lower())
            if words:
                words.append("")
                out.append("\n".join(words))
        return "".join(out), n

    def counts(self, texts: Iterable[str | None], most: int = 1 << 22) -> Iterator[int]:
        """Tokens of each text, in order; at most about ``most`` characters are in work at once (or one unbroken word)."""
        totals: list[int] = []
        work: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            lengths = np.array([len(b) for _, b in work], np.int64)
            changes = self.machine.run(np.frombuffer(b"".join(b for _, b in work), np.uint8))
            ends = np.concatenate([[0], np.cumsum(changes, dtype=np.int64)])
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            for (doc, _), got in zip(work, ends[bounds[1:]] - ends[bounds[:-1]], strict=True):
                totals[doc] += int(got)
            work.clear()
            size = 0

        for text in texts:
            totals.append(0)
            for piece in pieces(text or ""):
                body, n = self.stream(piece)
                totals[-1] += n
                if body:
                    work.append((len(totals) - 1, body.encode()))
                    size += len(work[-1][1])
                if size >= most:
                    flush()
        flush()
        return iter(totals)


_KEPT: dict[str, Counter] = {}


def counter(data: bytes) -> Counter:
    """One compiled transducer for each vocabulary and Python worker."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _KEPT:
        _KEPT[key] = Counter(data)
    return _KEPT[key]


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row for each input row: id, UTF-8 bytes, tokens, whether the tokens exceed ``limit``.

    ``tokenizer`` is the path of a tokenizers file, read on the driver and sent along (under 2 MB), so executors need
    no file of their own. No shuffle; other columns of ``docs`` are not read.
    """
    with open(tokenizer, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = np.fromiter(counter(data.value).counts(texts), np.int64, len(texts))
            size = [len(x.encode()) if x else 0 for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
