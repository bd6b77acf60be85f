"""Operator 10: personal data, by patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers (``base_spans``). A conditional random field
adds what patterns miss in context: its nodes are the tokens that hold a digit or ``@`` and spelled-out addresses
(others are of no kind), its local factors read a token's shape, length and neighbours, chain factors join neighbouring
nodes, and skip factors join each node to the one before it in the document, however far away, of the same letters and
digits or the same last digits, so that repeated or similarly written entities get one label. (Each repeat is joined to
the last only, so the factors grow with the number of tokens, and evidence still reaches all repeats.) Labels of base
spans are given; loopy message passing spreads them over the document, and tokens whose marginal reaches ``sure`` become
spans of their own, cut clear of base spans.

Weights are trained on the driver by pseudo-likelihood of the nodes that no pattern labels, given those that one does.
As the patterns say nothing of what they miss, the training texts get broken forms planted (``planted``): repeats of
their own entities in ways of writing that the patterns do not know, with the entity's label, and look-alikes of random
digits, with none. A broken form alone tells little then; what a repeat of a known entity means is learned. At most
``sample`` documents are used (those with the least hash of their id; documented bound). Where fewer than a tenth of
them hold a base span, that tenth is drawn, in the same order, from all documents that do. Detection reads all
documents, without a shuffle; graphs of many documents are run at once, a slice of tokens at a time.

Defined results: null and empty texts have no spans; texts of any length are searched whole, in linear time (long runs of
digits or word characters too); repeated rows get equal spans; without any base span in the documents the field
adds nothing; an empty table gives no rows; other columns are not read. Offsets count code points, end exclusive.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("email", "ip", "card", "phone")
LABELS = (None, *KINDS)
Span = tuple[str, int, int]

LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+(?<=[0-9])")
NODE = re.compile(r"[0-9@]\S*")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


#: An address with its sign and dots as words: the sign, in brackets or between spaces, then the domain.
AT_WORD = re.compile(r"\s?[\[({]\s?at\s?[\])}]\s?|\sat\s", re.I)
DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)"
SPELLED_DOMAIN = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{1,63}}){{1,8}}", re.I)
MARK_WORDS = re.compile(r"[\[({]\s?(?:at|dot)\s?[\])}]|\s(?:at|dot)\s", re.I)


def spelled_out(text: str) -> list[tuple[int, int]]:
    """Places that may be a spelled-out address: local part, the word ``at``, a domain of two parts or more."""
    out: list[tuple[int, int]] = []
    for m in AT_WORD.finditer(text):
        start, least = m.start(), max(m.start() - 64, out[-1][1] if out else 0)
        while start > least and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = SPELLED_DOMAIN.match(text, m.end()) if start < m.start() else None
        if domain:
            out.append((start, domain.end()))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches: from each ``@`` back over the local part (not past the last match), on over the domain."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, by kind as listed, then start."""
    out = emails(text)
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum(map(m[0].count, "0123456789")) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def shape(token: str) -> str:
    """Digits as 9, letters as a, runs over three cut."""
    s = re.sub(r"[0-9]", "9", token[:64])
    s = re.sub(r"[^\W\d_]", "a", s)
    return re.sub(r"(.)\1{3,}", r"\1\1\1", s)


@dataclass
class Nodes:
    """Tokens of one document that may be personal data, their features and factors."""

    spans: list[tuple[int, int]]
    features: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    given: list[int]


BITS = 14


def hashed(x: str) -> int:
    return zlib.crc32(x.encode()) & ((1 << BITS) - 1)


def places(text: str) -> list[tuple[int, int]]:
    """Spans of the nodes: tokens with a digit or ``@``, and spelled-out addresses whole, in order."""
    out: list[tuple[int, int]] = []
    spelled = spelled_out(text)
    at = k = 0
    while m := NODE.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        at = m.end()
        while k < len(spelled) and spelled[k][1] <= start:
            out.append(spelled[k])
            k += 1
        if k == len(spelled) or spelled[k][0] >= at:
            out.append((start, at))
    return sorted([*out, *spelled[k:]])


def nodes_of(text: str, base: list[Span]) -> Nodes:
    spans = places(text)
    by_start = sorted((s, e, LABELS.index(k)) for k, s, e in base)
    features, chain, skip, given = [], [], [], []
    last: dict[str, int] = {}
    b = 0
    for i, (s, e) in enumerate(spans):
        while b < len(by_start) and by_start[b][1] <= s:
            b += 1
        given.append(next((k for s2, e2, k in by_start[b : b + 4] if s2 < e and e2 > s), 0))
        token = text[s:e].strip(".,;:!?()[]{}<>\"'|#*$%&")
        plain, marks = MARK_WORDS.subn("", token.lower()) if " " in token or "(" in token or "[" in token or "{" in token else (token.lower(), 0)
        number = "".join(c for c in token[:256] if c.isdigit())
        before, after = text[max(0, s - 40) : s].split(), text[e : e + 40].split()
        names = (
            f"s{shape(token)}", f"n{min(len(number), 20)}", f"l{min(len(token), 24)}", f"a{'@' in token}", f"p{token.count('.')}",
            f"h{token.count('-')}", f"f{text[s]}", f"b{before[-1].lower()[:8] if before else ''}",
            f"c{after[0].lower()[:8] if after else ''}", f"d{len(number) == len(token)}",
            f"m{marks > 0}{any(c in token for c in '([{')}",
        )
        features.append([hashed(x) for x in names])
        if i and not text[spans[i - 1][1] : s].strip(" ()-."):
            chain.append((i - 1, i))
        letters = "".join(c for c in plain if c.isalnum())
        keys = [letters] if len(letters) >= 6 else []
        if len(number) >= 7:
            keys.append(f"..{number[-7:]}")
        skip += [(j, i) for j in sorted({last[key] for key in keys if key in last})]
        last.update(dict.fromkeys(keys, i))
    return Nodes(spans, features, chain, skip, given)


def broken(kind: str, entity: str, rng: random.Random) -> str:
    """The entity as the patterns do not know it."""
    if kind == "email":
        name, _, host = entity.partition("@")
        at = rng.choice([" (at) ", "(at)", " [at] ", " at ", " {at} "])
        return f"{name}{at}{host.replace('.', rng.choice(['.', '.', ' dot ', ' (dot) ']))}"
    digits = "".join(c for c in entity if c in "0123456789")
    if kind == "ip":
        return entity.replace(".", rng.choice(["-", ",", "_", "/"]))
    if kind == "card":
        return rng.choice([".", "/", "_", ":"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    tail = digits[-10:]
    if rng.random() < 0.5:  # the pattern takes the number and what follows as one, too long
        follows = ".".join(str(rng.randint(1, 255)) for _ in range(4)) if rng.random() < 0.5 else str(rng.randrange(10**7, 10**16))
        return f"{entity} {follows}"
    return rng.choice(["{}.{}.{}", "{}-{}-{}", "({}) {}-{}"]).format(tail[:-7], tail[-7:-4], tail[-4:])


def look_alike(kind: str, rng: random.Random) -> str:
    """Something written like a broken form that is no personal data."""
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    if kind == "email":
        return f"{rng.choice(['look', 'page', 'more', 'held', 'see'])} at {rng.choice(['www', 'docs', 'shop'])}.{rng.choice(['site', 'example', 'store'])}.{rng.choice(['com', 'org', 'net'])}"
    if kind == "card":
        digits = number(16)
        return broken("card", digits, rng) if not luhn(digits) else digits + number(8)
    if kind == "ip":
        return broken("ip", ".".join(number(3) for _ in range(4)), rng)
    return broken("phone", number(10), rng) if rng.random() < 0.7 else number(rng.randint(8, 15))


def planted(text: str, base: list[Span]) -> tuple[str, list[Span | tuple[None, int, int]]]:
    """The text with broken forms put in at spaces outside base spans, and where they and the base spans are in it:
    (kind or None, start, end).

    Two repeats of its own entities at most, and look-alikes in every other text, some of them twice."""
    rng = random.Random(zlib.crc32(text.encode()))
    put: list[tuple[str | None, str, int]] = []  # kind, form, characters of the form that are the entity
    for kind, s, e in rng.sample(base, min(2, len(base))):
        form = broken(kind, text[s:e], rng)
        put.append((kind, form, e - s if form.startswith(text[s:e]) else len(form)))
    if base and rng.random() < 0.3:
        name = f"{rng.choice(['ann', 'joe', 'max', 'kim'])}.{rng.randint(1, 99)}@{rng.choice(['mail', 'post'])}{rng.randint(1, 9)}.example.com"
        form = broken("email", name, rng)
        put.append(("email" if any(c in form for c in "([{") else None, form, len(form)))
    if rng.random() < 0.5:
        form = look_alike(rng.choice(KINDS), rng)
        put += [(None, form, len(form))] * rng.choice([1, 1, 2])
    at = []
    for kind, form, size in put:
        place = text.find(" ", rng.randrange(len(text) + 1)) if text else -1
        if place < 0 or any(s <= place < e for _, s, e in base):
            place = len(text)
        at.append((place, kind, form, size))
    at.sort(key=lambda x: x[0])
    out, labels, done, length = [], [], 0, 0
    for place, kind, form, size in at:
        out += [text[done:place], " ", form]
        length += place - done + 1
        labels.append((kind, length, length + size))
        length += len(form)
        done = place
    for kind, s, e in base:
        moved = sum(len(form) + 1 for place, _, form, _ in at if place <= s)
        labels.append((kind, s + moved, e + moved))
    return "".join([*out, text[done:]]), labels


@dataclass
class Example:
    """A training text's nodes, the label of each, and which labels are sure: given by a pattern or planted."""

    nodes: Nodes
    labels: list[int]
    sure: list[bool]


def training_example(text: str, base: list[Span]) -> Example:
    text, put = planted(text, base)
    g = nodes_of(text, base_spans(text))
    labels, sure = list(g.given), [x > 0 for x in g.given]
    for kind, start, end in put:
        for i, (s, e) in enumerate(g.spans):
            if s < end and e > start and not g.given[i]:
                labels[i], sure[i] = LABELS.index(kind), True
    return Example(g, labels, sure)


@dataclass
class Field:
    """Weights: local [feature, label], chain [left label, right label], skip [label, label], bias [label]."""

    local: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    bias: np.ndarray


def trained(examples: list[Example], certain: float = 0.5) -> Field | None:
    """A field from the examples. What patterns miss in the texts themselves has no label; so that it is not learned as
    none, a field from either half of the examples first labels such nodes of the other half."""
    halves = examples[::2], examples[1::2]
    for other, half in (halves, halves[::-1]):
        field = train_field([(x.nodes, x.labels) for x in other])
        if field is None or not half:
            continue
        p = marginals(field, [x.nodes for x in half])
        at = 0
        for x in half:
            for i, sure in enumerate(x.sure):
                if not sure and p[at + i].max() >= certain:
                    x.labels[i] = int(p[at + i].argmax())
            at += len(x.sure)
    return train_field([(x.nodes, x.labels) for x in examples])


def train_field(graphs: list[tuple[Nodes, list[int]]], rounds: int = 800, rate: float = 0.3, decay: float = 1e-3) -> Field | None:
    """Pseudo-likelihood of the nodes without a given label, each with its neighbours' labels, by gradient steps scaled
    per weight. None where no node has a label at all."""
    graphs = [(g, y) for g, y in graphs if g.spans]
    y = np.array([x for _, labels in graphs for x in labels], np.int64)
    if not y.any():
        return None
    free = np.array([not x for g, _ in graphs for x in g.given])
    k, n = len(LABELS), max(1, int(free.sum()))
    starts = np.cumsum([0, *[len(g.spans) for g, _ in graphs]])
    f = np.array([x for g, _ in graphs for x in g.features], np.int64)
    chain, skip = (
        np.array([(a + o, b + o) for (g, _), o in zip(graphs, starts, strict=False) for a, b in part(g)], np.int64).reshape(-1, 2)
        for part in (lambda g: g.chain, lambda g: g.skip)
    )
    one = np.eye(k)[y]
    local, ch, sk, bias = np.zeros((1 << BITS, k)), np.zeros((k, k)), np.zeros((k, k)), np.zeros(k)
    seen = [np.full(x.shape, 1e-8) for x in (local, ch, sk, bias)]
    for _ in range(rounds):
        z = local[f].sum(1) + bias
        np.add.at(z, chain[:, 1], ch[y[chain[:, 0]]])
        np.add.at(z, chain[:, 0], ch.T[y[chain[:, 1]]])
        np.add.at(z, skip[:, 1], sk[y[skip[:, 0]]])
        np.add.at(z, skip[:, 0], sk[y[skip[:, 1]]])
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - one) * free[:, None] / n
        g_local = np.stack([np.bincount(f.ravel(), np.repeat(g[:, j], f.shape[1]), 1 << BITS) for j in range(k)], 1)
        g_ch = one[chain[:, 0]].T @ g[chain[:, 1]] + (one[chain[:, 1]].T @ g[chain[:, 0]]).T
        g_sk = one[skip[:, 0]].T @ g[skip[:, 1]] + one[skip[:, 1]].T @ g[skip[:, 0]]
        g_sk = (g_sk + g_sk.T) / 2
        for w, grad, s in zip((local, ch, sk, bias), (g_local, g_ch, g_sk, g.sum(0)), seen, strict=True):
            grad = grad + decay / n * w
            s += grad * grad
            w -= rate * grad / np.sqrt(s)
    return Field(local, ch, sk, bias)


def marginals(field: Field, graphs: list[Nodes], rounds: int = 8) -> np.ndarray:
    """Label marginals of all nodes, one graph after another, by damped loopy sum-product messages."""
    k = len(LABELS)
    n = sum(len(g.spans) for g in graphs)
    starts = np.cumsum([0, *[len(g.spans) for g in graphs]])
    f = np.array([x for g in graphs for x in g.features], np.int64)
    given = np.array([x for g in graphs for x in g.given], np.int64)
    unary = field.local[f].sum(1) + field.bias
    fixed = given > 0
    unary[fixed] = np.where(np.eye(k)[given[fixed]] > 0, 0.0, -1e3)
    edges = [[(a + o, b + o) for g, o in zip(graphs, starts, strict=False) for a, b in part(g)] for part in (lambda g: g.chain, lambda g: g.skip)]
    pairs = np.array(edges[0] + edges[1], np.int64).reshape(-1, 2)
    if len(pairs):
        m = len(pairs)
        pot = np.concatenate([np.repeat(field.chain[None], len(edges[0]), 0), np.repeat(field.skip[None], len(edges[1]), 0)])
        src, dst = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        msg = np.zeros((2 * m, k))
        for _ in range(rounds):
            belief = unary + np.stack([np.bincount(dst, msg[:, j], n) for j in range(k)], 1)
            x = (belief[src] - msg[back])[:, :, None] + pot
            top = x.max(1)
            new = top + np.log(np.exp(x - top[:, None]).sum(1))
            msg = 0.5 * msg + 0.5 * (new - new.max(1, keepdims=True))
        unary = unary + np.stack([np.bincount(dst, msg[:, j], n) for j in range(k)], 1)
    p = np.exp(unary - unary.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


TRIM_LEFT, TRIM_RIGHT = "([{<\"'|,;:.!?#*$%&", ")]}>\"'|,;:.!?#*$%&"


def added_spans(text: str, g: Nodes, p: np.ndarray, base: list[Span], sure: float) -> list[Span]:
    """Spans of free nodes that the field is sure of; neighbours of one kind are one span."""
    out: list[Span] = []
    taken = sorted((s, e) for _, s, e in base)
    glued = {b for _, b in g.chain}
    for i, ((s, e), given) in enumerate(zip(g.spans, g.given, strict=True)):
        label = int(p[i].argmax())
        if given or not label or p[i, label] < sure:
            continue
        while s < e and text[s] in TRIM_LEFT:
            s += 1
        while e > s and text[e - 1] in TRIM_RIGHT:
            e -= 1
        if s == e or any(a < e and b > s for a, b in taken):
            continue
        if out and i in glued and out[-1][0] == LABELS[label] and not text[out[-1][2] : s].strip(" ()-."):
            out[-1] = (out[-1][0], out[-1][1], e)
        else:
            out.append((LABELS[label], s, e))
    return out


def find_spans(texts: list[str | None], field: Field | None, sure: float = 0.8, most_nodes: int = 20_000) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, ordered by kind as listed, then start."""
    out: list[tuple[list[Span], list[Span]]] = []
    waiting: list[tuple[int, str, Nodes]] = []

    def flush() -> None:
        if waiting:
            p = marginals(field, [g for _, _, g in waiting])
            at = 0
            for i, text, g in waiting:
                base = out[i][0]
                more = added_spans(text, g, p[at : at + len(g.spans)], base, sure)
                at += len(g.spans)
                if more:
                    out[i] = (base, sorted({*base, *more}, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))
            waiting.clear()

    size = 0
    for text in texts:
        text = text or ""
        base = base_spans(text)
        out.append((base, base))
        if field is not None:
            g = nodes_of(text, base)
            if not all(g.given):
                waiting.append((len(out) - 1, text, g))
                size += len(g.spans)
        if size > most_nodes:
            flush()
            size = 0
    if field is not None:
        flush()
    return out


def train(docs: DataFrame, sample: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> Field | None:
    """The field, from at most ``sample`` documents; none only where no document holds a base span."""
    texts = docs.select(F.xxhash64(F.col(id_col)).alias("h"), F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).alias("text"))
    keys = least_keys(texts.filter(F.col(id_col).isNotNull() & F.col("text").isNotNull()).select("h", "t"), sample)
    rows = texts.join(F.broadcast(keys), ["h", "t"]).orderBy("h", "t").limit(sample).collect()
    found = [(r.text, base_spans(r.text)) for r in rows]
    least = max(1, sample // 10)
    if sum(1 for _, base in found if base) < least:
        held = holders(docs, least, id_col, text_col)
        found = [(t, base_spans(t)) for t in held] + [x for x in found if not x[1]][: sample - len(held)]
    if not any(base for _, base in found):
        return None
    return trained([training_example(t, base) for t, base in found])


def least_keys(keys: DataFrame, most: int) -> DataFrame:
    """The ``most`` least distinct pairs (h, t); each partition hands on its own ``most`` only, so not all rows are shuffled."""

    def run(batches):
        import pyarrow as pa

        held = np.zeros((0, 2), np.int64)
        for batch in batches:
            new = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], 1)
            held = np.unique(np.concatenate([held, new]), axis=0)[:most]
        yield pa.RecordBatch.from_arrays([pa.array(held[:, 0]), pa.array(held[:, 1])], ["h", "t"])

    return keys.mapInArrow(run, "h long, t long").distinct().orderBy("h", "t").limit(most)


def holders(docs: DataFrame, most: int, id_col: str, text_col: str) -> list[str]:
    """At most ``most`` texts that hold a base span, those with the least hash of their id."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 1024):
            found = pa.array([bool(base_spans(x.as_py())) for x in batch.column(2)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(found), batch.column(1).filter(found)], ["h", "t"])

    rows = docs.select(F.xxhash64(F.col(id_col)).alias("h"), F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).alias("text")).filter("text is not null")
    keys = least_keys(rows.mapInArrow(run, "h long, t long"), most)  # keys only: a task sends few bytes
    return [r.text for r in rows.join(F.broadcast(keys), ["h", "t"]).orderBy("h", "t").limit(most).collect()]


def detect(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text", sure: float = 0.8) -> DataFrame:
    """Rows (id, base, spans): arrays of (kind, start, end)."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    span = "array<struct<kind:string,start:long,end:long>>"

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        rows = lambda spans: [dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = find_spans(part.column(1).to_pylist(), sent.value, sure)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([rows(b) for b, _ in found], kind), pa.array([rows(s) for _, s in found], kind)], ["id", "base", "spans"])

    id_kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {id_kind}, base {span}, spans {span}").withColumnRenamed("id", id_col)


def mask(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    if not spans:
        return text
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, field: Field | None, text_col: str = "text", sure: float = 0.8) -> Column:
    """Column: each text of ``docs`` with its personal data masked."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("string")
    def run(text):
        import pandas as pd

        out = []
        for at in range(0, len(text), 1024):
            texts = [t if isinstance(t, str) else None for t in text.iloc[at : at + 1024]]
            out += [mask(t, s) for t, (_, s) in zip(texts, find_spans(texts, sent.value, sure), strict=True)]
        return pd.Series(out, dtype=object)

    return run(F.col(text_col))
