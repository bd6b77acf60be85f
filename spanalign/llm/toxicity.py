"""Operator 8: toxicity scores by weak supervision.

Voters come from three places: a short list of insults, patterns (several insults, one insult repeated, an insult said to
"you", shouting), and lexicon terms mined from the labelled rows (whole words and word beginnings of four to six letters
that toxic documents hold much more often, each once and twice; of terms that begin one another, one votes). A voter fires on a document or
not. The given label is one more voter, which may be wrong like any other.

A generative label model treats the true label y as hidden: p(votes, y) is proportional to
exp(b y + sum of (a_j + c_j y) v_j + sum of w_jk v_j v_k). c_j says how much voter j tells, w_jk how far two voters repeat
each other whatever the label is. It is fitted without the true label, by expectation-maximisation of the
pseudo-likelihood, with a penalty that keeps most w at 0; labels only give the share of toxic rows. As the pair terms
cancel in the posterior, that is a logistic function of the sum of c_j v_j. The posterior labels then train a linear
(logistic) classifier over the mined terms, which scores every whole text.

Training takes at most ``per_class`` labelled documents of each class (those with the least hash of their id; documented
bound), only from rows that ``may_train`` allows. Terms are counted as rows; at most ``most_terms`` of them, the most
telling ones, are in the model, and at most ``most_voters`` vote. Only those terms and, for each training document, which
of them it holds reach the driver, however long its text. Scoring reads all documents, without a shuffle.

Defined results: null and empty texts get the score of a text without terms; very long texts are scored whole; repeated
rows get equal scores; of rows that repeat a labelled id, as many train as the bound allows; without labelled rows of
both classes the insult list alone scores; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, slices, stored

# Insults that vote without any labels.
INSULTS = (
    "asshole", "bastard", "bitch", "clown", "cretin", "disgusting", "dumb", "fool", "freak", "idiot", "imbecile",
    "jerk", "loser", "moron", "pathetic", "pig", "retard", "scum", "stupid", "trash", "vermin", "worthless",
)

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
INSULT = re.compile(rf"\b(?:{'|'.join(INSULTS)})\b", re.I)
SPOKEN_TO = re.compile(rf"\b(?:you|ur|your)\s+(?:\w+\s+)?(?:{'|'.join(INSULTS)})\b", re.I)
SHOUTED = re.compile(r"!!|[^\W\d_a-z]{3,}\s+[^\W\d_a-z]{3,}\s+[^\W\d_a-z]{3,}")
PATTERNS = ("several insults", "one insult repeated", "an insult to you", "shouting")


#: So many words of a term make it fire a second time, as the term with a plus sign.
OFTEN = 2


def words_of(text: str | None) -> Counter[str]:
    return Counter(WORD.findall((text or "").lower()))


def terms_of(word: str) -> list[str]:
    """The terms that a word stands for: itself and its beginnings."""
    return [f"{word}$", *(word[:n] for n in PREFIXES if len(word) >= n)]


def held_terms(text: str | None) -> set[str]:
    """All terms that the text holds."""
    n: Counter[str] = Counter()
    for word, times in words_of(text).items():
        for t in terms_of(word):
            n[t] += times
    return {*n, *(f"{t}+" for t, times in n.items() if times >= OFTEN)}


def patterns_of(text: str | None) -> list[int]:
    text = text or ""
    said = [x.lower() for x in INSULT.findall(text)]
    kinds = len(set(said))
    return [int(kinds > 1), int(len(said) > kinds), int(bool(SPOKEN_TO.search(text))), int(bool(SHOUTED.search(text)))]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    #: What the label model said: for each voter (term, pattern or "given label") its c.
    voters: dict[str, float] = field(default_factory=dict)
    #: Training rows whose posterior is on the other side of the given label.
    flipped: int = 0

    def scores(self, texts: Iterable[str | None]) -> list[float]:
        plain = {t.rstrip("+") for t in self.weights}
        known: dict[str, tuple[str, ...]] = {}
        out = []
        for text in texts:
            n: dict[str, int] = {}
            for w, times in words_of(text).items():
                got = known.get(w)
                if got is None:
                    if len(known) > 200_000:
                        known.clear()
                    got = known[w] = tuple(t for t in terms_of(w) if t in plain)
                for t in got:
                    n[t] = n.get(t, 0) + times
            held = [*n, *(f"{t}+" for t, times in n.items() if times >= OFTEN)]
            z = self.bias + sum(sorted(self.weights.get(t, 0.0) for t in held))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return out


@dataclass
class LabelModel:
    """Weights of p(votes, y): a and c for each voter, w for each pair, and the posterior's constant."""

    a: np.ndarray
    c: np.ndarray
    w: np.ndarray
    bias: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance of y = 1 for each row of votes."""
        return sigmoid(self.bias + votes @ self.c)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def balanced(z: np.ndarray, weight: np.ndarray, share: float) -> float:
    """The constant for which the weighted mean of the logistic function of z plus it is ``share``."""
    lo, hi = -60.0, 60.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.average(sigmoid(z + mid), weights=weight) < share else (lo, mid)
    return (lo + hi) / 2


def label_model(votes: np.ndarray, share: float, rounds: int = 30, steps: int = 40, sparse: float = 0.002, decay: float = 0.01, usual: float = 2.0, alone: int = 0) -> LabelModel:
    """Fit the label model on a matrix of votes [row, voter]; ``share`` is the share of rows with y = 1.

    No vote is taken for the truth: each voter, the given label too, starts with the same c (``usual``, towards which
    ``decay`` weakly draws it) and is then judged by how it agrees with the others. Voters speak for y = 1 or say
    nothing (c >= 0); otherwise voters that never meet, as of two languages, could come out on different sides. The
    last ``alone`` voters (annotators, who see what no lexicon does) have no pair weights: only y makes them agree."""
    rows, count = np.unique(np.asarray(votes, float), axis=0, return_counts=True)
    weight = count / count.sum()
    m = rows.shape[1]
    fired = weight @ rows
    a, c, w = np.log((fired + 1e-3) / (1 - fired + 1e-3)), np.full(m, usual), np.zeros((m, m))
    seen = [np.full(x.shape, 1e-6) for x in (a, c, w)]
    for _ in range(rounds):
        post = sigmoid(rows @ c + balanced(rows @ c, weight, share))
        for _ in range(steps):
            z = a + rows @ w
            off = [(sigmoid(z + y * c) - rows) * (weight * p)[:, None] for y, p in ((0, 1 - post), (1, post))]
            both = off[0] + off[1]
            g_w = rows.T @ both
            g_w = g_w + g_w.T
            np.fill_diagonal(g_w, 0)
            g_w[m - alone :] = g_w[:, m - alone :] = 0
            for x, g, s in zip((a, c, w), (both.sum(0), off[1].sum(0) + decay * fired * (c - usual), g_w), seen, strict=True):
                s += g * g
                x -= 0.3 * g / np.sqrt(s)
            w[:] = np.sign(w) * np.maximum(0, np.abs(w) - 0.3 * sparse / np.sqrt(seen[2]))
            np.maximum(c, 0, out=c)
    return LabelModel(a, c, w, balanced(rows @ c, weight, share))


def linear_classifier(rows: list[np.ndarray], width: int, target: np.ndarray, rounds: int = 400, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets over binary features, by gradient descent with momentum."""
    at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b, vw, vb = np.zeros(width), 0.0, np.zeros(width), 0.0
    rate = 4.0
    for _ in range(rounds):
        z = np.bincount(row, w[at], len(rows)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        vw = 0.9 * vw - rate * (np.bincount(at, g[row], width) + decay * w)
        vb = 0.9 * vb - rate * g.sum()
        w, b = w + vw, b + vb
        rate *= 0.995
    return w, float(b)


def begins(a: str, b: str) -> bool:
    a, b = a.rstrip("$+"), b.rstrip("$+")
    return a.startswith(b) or b.startswith(a)


def voters_of(terms: list[str], most: int) -> list[str]:
    """The terms that vote, most telling first: none that begins another one or begins with one."""
    out: list[str] = []
    for t in terms:
        if len(out) < most and not any(begins(t, x) for x in out):
            out.append(t)
    return out


SEEDS = [f"{w}$" for w in INSULTS]


def fit(terms: list[str], examples: list[tuple[list[int], list[int], int]], most_voters: int = 64) -> Model:
    """Train on (places of the held terms, pattern fires, label) rows; ``terms``: the most telling first, then seeds."""
    y = np.array([label for _, _, label in examples], int)
    if not y.any() or y.all():
        return Model({t: 4.0 for t in SEEDS}, -2.0)
    voters = voters_of(terms, most_voters)
    at = {terms.index(t): i for i, t in enumerate(voters)}
    votes = np.zeros((len(y), len(voters) + len(PATTERNS) + 1), np.int8)
    for i, (held, patterns, label) in enumerate(examples):
        votes[i, [at[x] for x in held if x in at]] = 1
        votes[i, len(voters) :] = [*patterns, label]
    heard = np.flatnonzero(votes.any(0))
    model = label_model(votes[:, heard], float(y.mean()), alone=1)
    post = model.posterior(votes[:, heard])
    names = [*voters, *PATTERNS, "given label"]
    w, b = linear_classifier([np.array(sorted(held), np.int64) for held, _, _ in examples], len(terms), post)
    weights = {t: float(v) for t, v in zip(terms, w, strict=True) if abs(v) > 1e-6}
    return Model(weights, b, {names[j]: float(x) for j, x in zip(heard, model.c, strict=True)}, int(((post >= 0.5) != (y == 1)).sum()))


def is_held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def telling_terms(sample: DataFrame, n: tuple[int, int], most: int) -> list[str]:
    """At most ``most`` terms that rows of label 1 hold much more often, by the z value of the difference of their shares.

    sample: (y, text); n: rows of label 0 and 1. The counts are rows; only the chosen terms come to the driver."""

    def held(batches):
        import pyarrow as pa

        for part in slices(batches, 32):
            lists = [sorted(held_terms(x.as_py())) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists, pa.list_(pa.string()))], ["y", "terms"])

    rows = sample.select("y", "text").mapInArrow(held, "y int, terms array<string>").select("y", F.explode("terms").alias("term"))
    counts = rows.groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    counts = counts.filter(F.col("a") + F.col("b") >= max(2, math.ceil(0.004 * n[1])))
    p1, p0 = (F.col("a") + 0.5) / (n[1] + 1), (F.col("b") + 0.5) / (n[0] + 1)
    counts = counts.select("term", p1.alias("p1"), p0.alias("p0"))
    z = (F.col("p1") - F.col("p0")) / F.sqrt(F.col("p1") * (1 - F.col("p1")) / n[1] + F.col("p0") * (1 - F.col("p0")) / n[0])
    told = counts.select("term", F.round(z, 9).alias("z")).filter((F.col("z") > 2) & (F.col("p1") > 4 * F.col("p0")))
    return [r.term for r in told.orderBy(F.desc("z"), "term").limit(most).collect()]


def train(docs: DataFrame, labels: DataFrame, may_train: Column | None = None, per_class: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_terms: int = 600, most_voters: int = 64) -> Model:
    """Fit on a bounded sample of the labelled rows. ``labels``: (id, label 0/1); null labels and ids are left out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    if may_train is not None:
        known = known.withColumnRenamed("id", id_col).filter(may_train).withColumnRenamed(id_col, "id")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    picked = [known.filter(F.col("y") == v).orderBy(F.xxhash64("id"), "id").limit(per_class) for v in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    spark, scratch = docs.sparkSession, []
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    sample = stored(texts.select("id", "y", "text").repartition(16, "id", F.xxhash64("text")), scratch)
    if sample.count() > 2 * per_class:  # ids repeat
        sample = stored(sample.orderBy(F.xxhash64("id"), F.xxhash64("text")).limit(2 * per_class), scratch)
    n = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    terms = telling_terms(sample, (n[0], n[1]), most_terms) if len(n) == 2 else []
    terms += [t for t in SEEDS if t not in set(terms)]
    place = {t: i for i, t in enumerate(terms)}

    def held(batches):
        import pyarrow as pa

        for part in slices(batches, 256):
            texts = [x.as_py() for x in part.column(1)]
            found = [sorted(place[t] for t in held_terms(x) if t in place) for x in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int32())), pa.array([patterns_of(x) for x in texts], pa.list_(pa.int32()))], ["y", "held", "patterns"])

    rows = sample.select("y", "text").mapInArrow(held, "y int, held array<int>, patterns array<int>").collect()
    discard(spark, scratch)
    return fit(terms, sorted((list(r.held), list(r.patterns), r.y) for r in rows), most_voters)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Column: the score of each text of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(text):
        import pandas as pd

        return pd.Series(sent.value.scores(text), dtype="float64")

    return run(F.col(text_col))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold."""
    name = free_name(docs.columns, "__toxicity")
    return docs.withColumn(name, score(docs, model, text_col)).filter(F.col(name) < threshold).drop(name)
