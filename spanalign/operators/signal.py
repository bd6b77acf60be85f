"""Signal operators: windowed spectra and resampling as relations, log-mel and polyphase resampling as array code."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_spectrum(samples: DataFrame, key: str, window: int, hop: int, floor: float = 1e-5) -> DataFrame:
    """(key, t, k, m): natural log of the magnitude spectrum of Hann-windowed frames of (key, i, value). Whole frames only.

    Each sample goes to the frames that hold it, then one aggregate for each frame sums all bins: no join."""
    first = F.floor(F.greatest(F.col("i") - (window - 1) + (hop - 1), F.lit(0)) / hop)
    framed = samples.select(key, F.explode(F.sequence(first, F.floor(F.col("i") / hop))).alias("t"), "i", "value").withColumn("j", F.col("i") - F.col("t") * hop)
    x = F.col("value") * (0.5 - 0.5 * F.cos(2 * math.pi * F.col("j") / window))
    angle = lambda k: 2 * math.pi * k * F.col("j") / window
    bins = range(window // 2 + 1)
    sums = framed.groupBy(key, "t").agg(F.count("*").alias("n"), *[F.sum(x * F.cos(angle(k))).alias(f"c{k}") for k in bins], *[F.sum(x * F.sin(angle(k))).alias(f"s{k}") for k in bins]).filter(F.col("n") == window)
    mags = F.array(*[F.log(F.greatest(F.sqrt(F.col(f"c{k}") ** 2 + F.col(f"s{k}") ** 2), F.lit(floor))) for k in bins])
    return sums.select(key, "t", F.posexplode(mags).alias("k", "m"))


def resample_tent(samples: DataFrame, key: str, up: int, down: int) -> DataFrame:
    """(key, j, y): samples at positions j * up / down, from the (at most four) inputs within two steps, tent-weighted and
    normalised everywhere. Each input goes to the outputs that it touches, then one aggregate: no range join."""
    step = up / down
    length = samples.groupBy(key).agg(F.count("*").alias("n"))
    lo, hi = F.floor((F.col("i") - 2) / step) + 1, F.ceil((F.col("i") + 2) / step) - 1
    spread = samples.select(key, F.explode(F.sequence(F.greatest(lo, F.lit(0)), hi)).alias("j"), "i", "value").withColumn("w", 1 - F.abs(F.col("i") - F.col("j") * step) / 2).filter("w > 0")
    out = spread.groupBy(key, "j").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("y"))
    return out.join(length, key).filter(F.col("j") < F.floor(F.col("n") * down / up)).select(key, "j", "y")


def hz_to_mel(hz: np.ndarray) -> np.ndarray:
    """Slaney's scale: linear below 1 kHz, logarithmic above."""
    hz = np.asarray(hz, float)
    return np.where(hz < 1000, hz * 3 / 200, 15 + np.log(np.maximum(hz, 1e-9) / 1000) * 27 / math.log(6.4))


def mel_to_hz(mel: np.ndarray) -> np.ndarray:
    mel = np.asarray(mel, float)
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * math.log(6.4) / 27))


def mel_filters(rate: int, n_fft: int, mels: int, low: float, high: float) -> np.ndarray:
    """Triangular filters [mels, bins] of equal area."""
    edges = mel_to_hz(np.linspace(hz_to_mel(low), hz_to_mel(high), mels + 2))
    freq = np.arange(n_fft // 2 + 1) * rate / n_fft
    rise = (freq - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - freq) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(wave: np.ndarray, rate: int = 48000, hop: int = 480, n_fft: int = 2048, mels: int = 80, low: float = 0, high: float = 8000, floor: float = 1e-5) -> np.ndarray:
    """Log-mel frames [T, mels] of a mono waveform: reflect-padded, Hann-windowed magnitude spectra."""
    left, right = (n_fft - hop) // 2, (n_fft - hop + 1) // 2
    if len(wave) <= right:
        raise ValueError("the waveform is shorter than the padding")
    padded = np.pad(np.asarray(wave, float), (left, right), mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop][: len(wave) // hop]
    hann = 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(n_fft) / n_fft)
    return np.log(np.maximum(np.abs(np.fft.rfft(frames * hann, axis=1)) @ mel_filters(rate, n_fft, mels, low, high).T, floor))


def resample(wave: np.ndarray, rate: int, to: int, half: int = 32, beta: float = 8.6, rolloff: float = 0.95) -> np.ndarray:
    """Kaiser-windowed sinc resampling, every output's taps normalised to sum 1."""
    if rate == to or not len(wave):
        return np.asarray(wave, float)
    cut = rolloff * min(1.0, to / rate)
    x, offsets = np.asarray(wave, float), np.arange(-half + 1, half + 1)
    out = np.empty(int(len(x) * to // rate))
    for first in range(0, len(out), 1 << 15):  # bounds the table of taps
        at = np.arange(first, min(first + (1 << 15), len(out))) * rate / to
        taps = np.floor(at).astype(int)[:, None] + offsets
        d = taps - at[:, None]
        w = np.sinc(d * cut) * np.i0(beta * np.sqrt(np.maximum(0, 1 - (d / half) ** 2))) / np.i0(beta)
        w = np.where((taps >= 0) & (taps < len(x)), w, 0)
        out[first : first + len(at)] = (x[np.clip(taps, 0, len(x) - 1)] * w).sum(1) / w.sum(1)
    return out
