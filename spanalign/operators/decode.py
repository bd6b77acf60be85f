"""Alignment decode: the best monotone segmentation of frames into a known label sequence."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

WAIT, EXIT, SKIP = 0, 1, 2


def boundaries(n: int, groups: Sequence[int] | None) -> np.ndarray:
    """Where a gap may lie: before the first, after the last and between labels of different groups."""
    free = np.ones(n + 1, bool)
    if groups is not None:
        g = np.asarray(groups)
        free[1:n] = g[1:] != g[:-1]
    return free


def anchor_skipped(spans: list[list[int]], frames: int, free: np.ndarray) -> list[tuple[int, int]]:
    """Zero-width spans lie at a neighbour's edge: at the last wide span's end (0 without one) as long as no gap was
    permitted since that span, else at the next wide span's start (the end of the frames without one)."""
    on, off = np.asarray(spans, np.int64).reshape(-1, 2).T
    n, at = len(on), np.arange(len(on))
    wide = on < off
    before = np.maximum.accumulate(np.where(wide, at, -1))  # the last wide span up to here
    after = np.minimum.accumulate(np.where(wide, at, n)[::-1])[::-1]
    gap = np.maximum.accumulate(np.where(free[:n], at, -1))  # the last place up to here where a gap may lie
    left, right = np.concatenate([off, [0]])[before], np.concatenate([on, [frames]])[after]
    place = np.where(gap > before, right, left)
    return list(zip(np.where(wide, on, place).tolist(), np.where(wide, off, place).tolist(), strict=True))


def decode(similarity: np.ndarray, groups: Sequence[int] | None = None, penalty: float = 0.5) -> tuple[list[tuple[int, int]], float]:
    """Spans (first frame, end) of each label, and the score: similarity inside spans less ``penalty`` for each skip.

    A label in progress wins ties against entering it; at a boundary, waiting wins over leaving a label over skipping."""
    frames, n = similarity.shape
    if frames < 1 or n < 1 or penalty < 0 or (groups is not None and len(groups) != n):
        raise ValueError("decode needs frames, labels, a penalty of 0 or more and one group for each label")
    free = boundaries(n, groups)
    gap = -penalty * np.arange(n + 1, dtype=float)
    for i in range(1, n + 1):
        gap[i] = gap[i - 1] - penalty
    token = np.full(n, -np.inf)
    entered = np.zeros((frames + 1, n), bool)
    move = np.zeros((frames + 1, n + 1), np.int8)
    move[0, 1:] = SKIP
    for t in range(1, frames + 1):
        enter = gap[:-1] > token
        entered[t] = enter
        token = np.where(enter, gap[:-1], token) + similarity[t - 1]
        now = np.where(free, gap, -np.inf)
        leave = token > now[1:]
        now[1:] = np.where(leave, token, now[1:])
        move[t, 1:] = np.where(leave, EXIT, WAIT)
        if (now[:-1] - penalty > now[1:]).any():
            for i in range(1, n + 1):
                if now[i - 1] - penalty > now[i]:
                    now[i], move[t, i] = now[i - 1] - penalty, SKIP
        gap = now
    spans = [[0, 0] for _ in range(n)]
    t, i = frames, n
    while i > 0:
        how = move[t, i]
        if how == SKIP:
            spans[i - 1] = [t, t]
            i -= 1
        elif how == WAIT and t:
            t -= 1
        else:
            end = t
            while not entered[t, i - 1]:
                t -= 1
            t -= 1
            spans[i - 1] = [t, end]
            i -= 1
    return anchor_skipped(spans, frames, free), float(gap[n])


def decode_clips(sims: DataFrame, key: str = "clip_id", penalty: float = 0.5) -> DataFrame:
    """(key, n, on_f, off_f, score) for rows (key, t, sims: array of a frame's similarities to each label).

    A clip is one bounded unit of work (at most a few thousand frames); clips spread over tasks by key."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("t")
        spans, score = decode(np.array(pdf.sims.tolist(), float), None, penalty)
        return pd.DataFrame({key: pdf[key].iloc[0], "n": range(len(spans)), "on_f": [a for a, _ in spans], "off_f": [b for _, b in spans], "score": score})

    return sims.select(key, "t", "sims").groupBy(key).applyInPandas(run, f"{key} {sims.schema[key].dataType.simpleString()}, n int, on_f int, off_f int, score double")
