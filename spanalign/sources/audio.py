"""Audio files as rows: Spark reads the bytes, executors decode them."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("wav", "flac", "mp3")


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, mono samples in -1 .. 1) of a RIFF file: integer PCM of 8 to 32 bits or 32/64-bit floats; channels are averaged."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", data, at + 8)
            if form[0] == 0xFFFE and size >= 26:
                form = (struct.unpack_from("<H", data, at + 32)[0], *form[1:])
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or not body:
        raise ValueError("a WAV file without format or samples")
    kind, channels, rate, _, _, bits = form
    if kind == 3 and bits in (32, 64):
        x = np.frombuffer(body[: len(body) // (bits // 8) * (bits // 8)], f"<f{bits // 8}").astype(float)
    elif kind == 1 and bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(float) - 128) / 128
    elif kind == 1 and bits in (16, 32):
        x = np.frombuffer(body[: len(body) // (bits // 8) * (bits // 8)], f"<i{bits // 8}").astype(float) / (1 << bits - 1)
    elif kind == 1 and bits == 24:
        raw = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8).astype(float) / (1 << 23)
    else:
        raise ValueError(f"WAV kind {kind} with {bits} bits")
    return rate, x[: len(x) // channels * channels].reshape(-1, channels).mean(1)


DECODERS: dict[str, Callable[[bytes], tuple[int, np.ndarray]]] = {"wav": decode_wav}


def read_clips(spark: SparkSession, path: str) -> DataFrame:
    """(path, sample_rate, samples, error) of every audio file under a folder. A file that can't be decoded keeps its row, with
    the reason in ``error``; decoders for other formats can be added to ``DECODERS``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return decoded(files.filter(F.lower("path").rlike(rf"\.({'|'.join(SUFFIXES)})$")))


def decoded(files: DataFrame) -> DataFrame:
    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    kind = path.rpartition(".")[2].lower()
                    if kind not in DECODERS:
                        raise ValueError(f"no decoder for {kind}")
                    rate, x = DECODERS[kind](bytes(content))
                    rows.append((path, rate, x.astype(np.float32), None))
                except Exception as e:  # one bad file must not end the job
                    rows.append((path, None, None, str(e)))
            yield pd.DataFrame({"path": [r[0] for r in rows], "sample_rate": pd.array([r[1] for r in rows], "Int32"), "samples": [r[2] for r in rows], "error": [r[3] for r in rows]})

    return files.select("path", "content").mapInPandas(run, "path string, sample_rate int, samples array<float>, error string")
