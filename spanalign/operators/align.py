"""The whole way from waveforms and label sequences to spans, quality measures and tiers.

A clip is one bounded unit: its waveform, features and similarities live in one call and never cross a shuffle; only
spans (a few rows a label) do."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip_language
from . import decode, lookup, network, signal, tiers
from .metrics import FLOOR, HALF_WIDTH

FIELDS = ("confidence", "determinacy", "monotonicity", "agreement")


def vocabulary_table(spark: SparkSession, vocabulary: dict) -> DataFrame:
    """(symbol, token_id, is_global, is_stop) of ``model_file.vocabulary_of``."""
    rows = [(s, i, s in vocabulary["global_symbols"], s in vocabulary["stop_symbols"]) for s, i in vocabulary["symbols"].items()]
    return spark.createDataFrame(rows, "symbol string, token_id int, is_global boolean, is_stop boolean")


def encode(labels: DataFrame, vocab: DataFrame, global_symbols: list[str], stop_symbols: list[str], key: str = "clip_id") -> DataFrame:
    """(key, labels, ids, error) for rows (key, n, label, lang): stop symbols go, the others are looked up.

    A clip with an unknown label, or with none left, keeps its row with the reason in ``error``."""
    kept = labels.withColumn("symbol", F.col("label")).withColumn("__stop", F.col("label").isin(stop_symbols))
    found = lookup.resolve(kept, vocab.select("symbol", "token_id"), global_symbols)
    item = F.struct("n", F.col("symbol").alias("label"), "token_id")
    lists = found.groupBy(key).agg(F.array_sort(F.collect_list(F.when(~F.col("__stop"), item))).alias("x"))
    unknown = F.filter("x", lambda v: v["token_id"].isNull())
    error = F.when(F.size("x") == 0, "no labels").when(F.size(unknown) > 0, F.concat(F.lit("unknown label "), unknown[0]["label"]))
    return lists.select(key, F.transform("x", lambda v: v["label"]).alias("labels"), F.transform("x", lambda v: v["token_id"]).alias("ids"), error.alias("error"))


def measures(sims: np.ndarray, spans: list[tuple[int, int]], logits: np.ndarray | None = None, ids: np.ndarray | None = None) -> dict[str, float]:
    """The measures of ``operators.metrics`` for one clip, and the mean probability of the labels' own ids."""
    frames, n = sims.shape
    on, off = np.array(spans, int).T
    owner = np.searchsorted(on, np.arange(frames), "right") - 1
    inside = (owner >= 0) & (np.arange(frames) < off[owner])
    a = np.maximum(sims, 0) ** 2
    sums = np.concatenate([np.zeros((frames, 1)), a.cumsum(1)], 1)
    at = np.where(inside, owner, np.minimum(owner + 1, n - 1))
    row = np.arange(frames)
    local = sums[row, np.minimum(at + HALF_WIDTH + 1, n)] - sums[row, np.maximum(at - HALF_WIDTH, 0)]
    owned = row[inside & (sums[:, -1] > 0)]
    later = 1 - sums[owned, owner[owned]] / sums[owned, -1]
    out = {"confidence": float(np.mean([sims[s:e, i].mean() if s < e else 0.0 for i, (s, e) in enumerate(spans)])), "determinacy": float(a[row[inside], owner[inside]].sum() / (local.sum() + FLOOR)), "monotonicity": float(later.mean()) if len(owned) else 0.0, "agreement": 0.0}
    if logits is not None and len(logits):
        z = np.exp(logits - logits.max(1, keepdims=True))
        out["agreement"] = float((z[np.arange(len(ids)), ids] / z.sum(1)).mean())
    return out


def align_clips(clips: DataFrame, weights: network.Weights, c: network.Config, penalty: float = 0.5, max_frames: int = 6000, rate: int = 48000, hop: int = 480) -> DataFrame:
    """(clip_id, num_frames, spans, score, measures.., error) for rows (clip_id, sample_rate, samples, ids, error[, groups]).

    ``spans`` are (n, on_f, off_f) in frames. One pass over the clips without a shuffle. A clip that already has an error, that is too
    short or longer than ``max_frames``, or that fails keeps its row with the reason; others go on. ``groups`` (one
    number a label) forbids gaps between labels of one group."""
    sent = clips.sparkSession.sparkContext.broadcast(weights)
    cols = ["clip_id", "sample_rate", "samples", "ids", "error"] + (["groups"] if "groups" in clips.columns else [])

    def one(r) -> tuple:
        if isinstance(r.error, str):
            raise ValueError(r.error)
        if int(len(r.samples) * rate // r.sample_rate) // hop > max_frames:
            raise ValueError(f"longer than {max_frames} frames")
        mel = signal.log_mel(signal.resample(np.asarray(r.samples, float), int(r.sample_rate), rate), rate, hop, mels=c.mels)
        ids = np.asarray(r.ids, int)
        out = network.forward(mel, ids, sent.value, c)
        groups = getattr(r, "groups", None)
        spans, score = decode.decode(out["similarity"], None if groups is None else list(groups), penalty)
        m = measures(out["similarity"], spans, out["token_logits"], ids)
        return (r.clip_id, len(mel), [{"n": i, "on_f": a, "off_f": b} for i, (a, b) in enumerate(spans)], score, *(m[f] for f in FIELDS), None)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    rows.append(one(r))
                except Exception as e:  # one bad clip must not end the job
                    rows.append((r.clip_id, None, None, None, *(None for _ in FIELDS), str(e)))
            out = pd.DataFrame(rows, columns=["clip_id", "num_frames", "spans", "score", *FIELDS, "error"])
            yield out.astype({"num_frames": "Int32"} | {f: "Float64" for f in ("score", *FIELDS)})

    kind = clips.schema["clip_id"].dataType.simpleString()
    schema = f"clip_id {kind}, num_frames int, spans array<struct<n int, on_f int, off_f int>>, score double, {', '.join(f'{f} double' for f in FIELDS)}, error string"
    return clips.select(*cols).mapInPandas(run, schema)


def span_rows(aligned: DataFrame, encoded: DataFrame, language: str | None = None, frame_ms: int = 10) -> DataFrame:
    """(clip_id, n, label, on_ms, off_ms, end_ms, group_id, word_id) of the clips that were aligned; the language
    prefix leaves the labels. Without owners every label is its own group and all belong to word 1."""
    label = F.col("labels")[F.col("s.n")]
    spans = aligned.filter("error is null").select("clip_id", "num_frames", F.explode("spans").alias("s")).join(encoded.select("clip_id", "labels"), "clip_id")
    ms = lambda f: (f * frame_ms).cast("long")
    own = (F.col("s.n") + 1).cast("long")
    return spans.select("clip_id", F.col("s.n").cast("long").alias("n"), (strip_language(label, F.lit(language)) if language else label).alias("label"), ms(F.col("s.on_f")).alias("on_ms"), ms(F.col("s.off_f")).alias("off_ms"), ms(F.col("num_frames")).alias("end_ms"), own.alias("group_id"), F.lit(1).cast("long").alias("word_id"))


def build_tiers(spans: DataFrame, skips: str = "omit", fill: str = "SP", group_text: str = "label", word_text: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Gap-filled rows (clip_id, tier_ord, tier, on_ms, off_ms, text) of the tiers texts, words and phones, and
    (clip_id, end_ms). ``group_text`` and ``word_text`` name columns with the owners' texts (none: empty)."""
    kept = tiers.clamp(tiers.handle_skips(spans, "clip_id", skips, end="end_ms"), "clip_id", "n")
    ends = kept.groupBy("clip_id").agg(F.greatest(F.max("end_ms"), F.max("off_ms")).alias("end_ms"))

    def merged(owner: str, text: str | None) -> DataFrame:
        said = F.coalesce(F.col(text), F.lit("")) if text else F.lit("")
        named = kept.withColumn("owner", F.col(owner)).withColumn("text", said)
        first = tiers.runs(named.withColumn("o", F.struct("owner")), "clip_id", "n", "o")
        of_owner = named.groupBy("clip_id", "owner").agg(F.min_by("text", "n").alias("text"))
        return first.select("clip_id", F.col("o.owner").alias("owner"), "on_ms", "off_ms").join(of_owner, ["clip_id", "owner"]).drop("owner")

    parts = [(1, "texts", merged("word_id", word_text), ""), (2, "words", merged("group_id", group_text), ""), (3, "phones", kept.withColumn("text", F.col("label")), fill)]
    out = None
    for i, name, rows, label in parts:
        filled = tiers.fill_gaps(rows, "clip_id", ends, label).select("clip_id", F.lit(i).alias("tier_ord"), F.lit(name).alias("tier"), "on_ms", "off_ms", "text")
        out = filled if out is None else out.unionByName(filled)
    return out, ends


def inherit_owners(intervals: DataFrame, stop_symbols: list[str], phones_tier: str = "phones", key: str = "clip_id") -> DataFrame:
    """(key, n, label, word_id, group_id, word_text, group_text): the labels of a first pass's tiers, without stop
    symbols, with the numbers and texts of the intervals of its tiers texts and words that hold their midpoints (else
    of the last that start before, else 1). Empty intervals own nothing; keys without both tiers give no rows.

    intervals: (key, tier, ord, xmin, xmax, text), read once for all tiers."""
    micro = lambda x: F.round(x * 1e6).cast("long")
    said = intervals.filter("text <> ''")

    def owners(tier: str) -> DataFrame:
        rows = said.filter(F.col("tier") == tier)
        return rows.select(key, F.row_number().over(Window.partitionBy(key).orderBy("ord")).alias("ord"), micro(F.col("xmin")).alias("on_ms"), micro(F.col("xmax")).alias("off_ms"), "text")

    out = said.filter(F.col("tier") == phones_tier).filter(~F.col("text").isin(stop_symbols))
    out = out.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("ord")) - 1).cast("long").alias("n"), F.col("text").alias("label"), micro((F.col("xmin") + F.col("xmax")) / 2).alias("at_ms"))
    for tier, number in (("texts", "word"), ("words", "group")):
        held = owners(tier)
        named = held.select(key, F.col("ord").cast("long").alias(f"{number}_id"), F.col("text").alias(f"{number}_text"))
        out = lookup.owner_at(out, held, key).withColumn(f"{number}_id", F.col("owner").cast("long")).drop("owner").join(named, [key, f"{number}_id"])
    return out.select(key, "n", "label", "word_id", "group_id", "word_text", "group_text")
