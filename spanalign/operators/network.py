"""The two-stream network's layers as array functions, and the forward pass over rows of clips.

No weights are supplied here: ``sources.model_file`` reads them, ``random_weights`` gives seeded ones for tests.
Stream 0 holds the labels, stream 1 the frames. Biases and layer scales that the weights lack are left out."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class Config:
    dim: int = 256
    layers: int = 8
    heads: int = 8
    head_dim: int = 64
    ffn: int = 1024
    conv: int = 1024
    kernel: int = 31
    merge_kernel: int = 5
    mels: int = 80
    vocab: int = 256
    out: int = 256
    theta: float = 1e4
    eps: float = 1e-6


#: Nodes of a cubic interpolation of erf on [0, 6]; its error stays below 1e-11.
STEPS = 256
NODES = np.arange(6 * STEPS + 2) / STEPS
VALUES = np.array([math.erf(x) for x in NODES])
SLOPES = 2 / math.sqrt(math.pi) * np.exp(-NODES * NODES) / STEPS


def erf(x: np.ndarray) -> np.ndarray:
    """Error function, element by element, by Hermite interpolation between exact nodes."""
    at = np.minimum(np.abs(x), 6.0) * STEPS
    i = at.astype(np.int32)
    t = at - i
    u = 1 - t
    y = u * u * ((1 + 2 * t) * VALUES[i] + t * SLOPES[i]) + t * t * ((3 - 2 * t) * VALUES[i + 1] - u * SLOPES[i + 1])
    return np.copysign(y, x)


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def rms_norm(x: np.ndarray, w: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + eps) * w


def linear(x: np.ndarray, w: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    return x @ w.T if b is None else x @ w.T + b


def depthwise(x: np.ndarray, kernel: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """Same-padded depthwise convolution over time; kernel [channels, K]."""
    k = kernel.shape[1]
    padded = np.pad(x, ((k // 2, k - 1 - k // 2), (0, 0)))
    out = sum(padded[i : i + len(x)] * kernel[:, i] for i in range(k))
    return out if b is None else out + b


def rope(x: np.ndarray, theta: float) -> np.ndarray:
    """Rotates neighbouring pairs of [time, heads, head_dim] by position."""
    half = x.shape[-1] // 2
    angle = np.arange(len(x))[:, None] * theta ** (-np.arange(half) / half)
    c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
    out = np.empty_like(x)
    out[..., 0::2], out[..., 1::2] = x[..., 0::2] * c - x[..., 1::2] * s, x[..., 0::2] * s + x[..., 1::2] * c
    return out


def ffn(x: np.ndarray, w: Weights, p: str) -> np.ndarray:
    a, b = np.split(linear(x, w[f"{p}.w1"], w[f"{p}.b1"]), 2, -1)
    return linear(gelu(a) * b, w[f"{p}.w2"], w[f"{p}.b2"])


def conv_gate(x: np.ndarray, w: Weights, p: str, eps: float) -> np.ndarray:
    a, b = np.split(gelu(linear(x, w[f"{p}.w1"], w[f"{p}.b1"])), 2, -1)
    gate = gelu(depthwise(rms_norm(b, w[f"{p}.norm"], eps), w[f"{p}.dw"], w.get(f"{p}.db")))
    return linear(a * gate, w[f"{p}.w2"], w[f"{p}.b2"])


def attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, rows: int = 256) -> np.ndarray:
    """Softmax attention [time, heads, dim], some query rows at a time, so the score matrix stays small."""
    out = np.empty_like(q)
    for at in range(0, len(q), rows):
        z = np.einsum("qhd,khd->hqk", q[at : at + rows], k) / math.sqrt(q.shape[-1])
        z = np.exp(z - z.max(-1, keepdims=True))
        out[at : at + rows] = np.einsum("hqk,khd->qhd", z / z.sum(-1, keepdims=True), v)
    return out


def joint_attention(streams: list[np.ndarray], w: Weights, p: str, c: Config) -> list[np.ndarray]:
    """Both streams attend to both; own projections, norms and positions for each stream."""
    parts = []
    for i, x in enumerate(streams):
        qkv = linear(rms_norm(x, w[f"{p}.{i}.norm"], c.eps), w[f"{p}.{i}.qkv"], w.get(f"{p}.{i}.qkv_b")).reshape(len(x), 3, c.heads, c.head_dim)
        q, k = (rope(rms_norm(qkv[:, j], w[f"{p}.{i}.{n}"], c.eps), c.theta) for j, n in ((0, "q"), (1, "k")))
        parts.append((q, k, qkv[:, 2]))
    q, k, v = (np.concatenate([part[j] for part in parts]) for j in range(3))
    out = np.split(attention(q, k, v).reshape(len(q), -1), [len(streams[0])])
    return [linear(o, w[f"{p}.{i}.out"], w.get(f"{p}.{i}.out_b")) for i, o in enumerate(out)]


def block(streams: list[np.ndarray], w: Weights, p: str, c: Config) -> list[np.ndarray]:
    add = lambda x, y, name: x + y * w.get(f"{p}.{name}.scale", 1.0)
    feed = lambda x, i, f: add(x, ffn(rms_norm(x, w[f"{p}.{f}.{i}.norm"], c.eps), w, f"{p}.{f}.{i}"), f"{f}.{i}") if f"{p}.{f}.{i}.norm" in w else x
    streams = [feed(x, i, "f1") for i, x in enumerate(streams)]
    attended = joint_attention(streams, w, f"{p}.att", c)
    for i, x in enumerate(streams):
        gated = conv_gate(rms_norm(x, w[f"{p}.cg.{i}.pre"], c.eps), w, f"{p}.cg.{i}", c.eps)
        both = np.concatenate([attended[i], gated], -1)
        if f"{p}.mg.{i}.dw" in w:
            both = both + depthwise(both, w[f"{p}.mg.{i}.dw"], w.get(f"{p}.mg.{i}.db"))
        streams[i] = add(x, linear(both, w[f"{p}.mg.{i}.w"], w[f"{p}.mg.{i}.b"]), f"mg.{i}")
    return [feed(x, i, "f2") for i, x in enumerate(streams)]


def forward(mel: np.ndarray, ids: np.ndarray, w: Weights, c: Config) -> dict[str, np.ndarray]:
    """Features and logits of frames and tokens, and their cosine similarity [frames, tokens]."""
    streams = [linear(w["embed"][ids], w["text.w"], w["text.b"]), linear(mel, w["audio.w"], w["audio.b"])]
    for k in range(c.layers):
        streams = block(streams, w, f"b{k}", c)
    if "norm.0" in w:
        streams = [rms_norm(x, w[f"norm.{i}"], c.eps) for i, x in enumerate(streams)]
    outs = [linear(x, w[f"out.{i}.w"], w[f"out.{i}.b"]) for i, x in enumerate(streams)]
    (tf, tl), (ff, fl) = (np.split(o, [c.out], -1) for o in outs)
    unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-8)
    return {"token_features": tf, "token_logits": tl, "frame_features": ff, "frame_logits": fl, "similarity": unit(ff) @ unit(tf).T}


def random_weights(c: Config, seed: int = 0) -> Weights:
    rng = np.random.default_rng(seed)
    w: Weights = {}
    mat = lambda o, i: rng.normal(0, 1 / math.sqrt(i), (o, i))
    inner = c.heads * c.head_dim
    w |= {"embed": rng.normal(0, 1, (c.vocab, c.dim)), "text.w": mat(c.dim, c.dim), "text.b": np.zeros(c.dim), "audio.w": mat(c.dim, c.mels), "audio.b": np.zeros(c.dim)}
    for i in (0, 1):
        w |= {f"norm.{i}": np.ones(c.dim), f"out.{i}.w": mat(c.out + c.vocab, c.dim), f"out.{i}.b": np.zeros(c.out + c.vocab)}
    for k in range(c.layers):
        for i in (0, 1):
            for f in ("f1", "f2"):
                p = f"b{k}.{f}.{i}"
                w |= {f"{p}.norm": np.ones(c.dim), f"{p}.scale": np.full(c.dim, 0.1), f"{p}.w1": mat(2 * c.ffn, c.dim), f"{p}.b1": np.zeros(2 * c.ffn), f"{p}.w2": mat(c.dim, c.ffn), f"{p}.b2": np.zeros(c.dim)}
            p = f"b{k}.att.{i}"
            w |= {f"{p}.norm": np.ones(c.dim), f"{p}.qkv": mat(3 * inner, c.dim), f"{p}.q": np.ones(c.head_dim), f"{p}.k": np.ones(c.head_dim), f"{p}.out": mat(c.dim, inner)}
            p = f"b{k}.cg.{i}"
            w |= {f"{p}.pre": np.ones(c.dim), f"{p}.w1": mat(2 * c.conv, c.dim), f"{p}.b1": np.zeros(2 * c.conv), f"{p}.norm": np.ones(c.conv), f"{p}.dw": mat(c.conv, c.kernel), f"{p}.db": np.zeros(c.conv), f"{p}.w2": mat(c.dim, c.conv), f"{p}.b2": np.zeros(c.dim)}
            p = f"b{k}.mg.{i}"
            w |= {f"{p}.dw": mat(2 * c.dim, c.merge_kernel), f"{p}.db": np.zeros(2 * c.dim), f"{p}.w": mat(c.dim, 2 * c.dim), f"{p}.b": np.zeros(c.dim), f"{p}.scale": np.full(c.dim, 0.1)}
    return w


def forward_clips(clips: DataFrame, weights: Weights, c: Config, max_frames: int = 6000) -> DataFrame:
    """(clip_id, t, sims) for rows (clip_id, mel: array of frames, ids): too long clips are left out before any inference."""
    sent = clips.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples():
                s = forward(np.array(r.mel.tolist(), float), np.array(r.ids, int), sent.value, c)["similarity"]
                yield pd.DataFrame({"clip_id": r.clip_id, "t": range(len(s)), "sims": list(s)})

    few = clips.filter(f"size(mel) between 1 and {max_frames} and size(ids) > 0").select("clip_id", "mel", "ids")
    return few.mapInPandas(run, f"clip_id {clips.schema['clip_id'].dataType.simpleString()}, t long, sims array<double>")
