"""PCM WAV files as rows of samples, and back."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from vocalake.operators.kernels import resampled


def decode(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, mono samples between -1 and 1) of 8, 16 or 32 bit PCM."""
    with wave.open(io.BytesIO(data)) as file:
        width, channels, rate = file.getsampwidth(), file.getnchannels(), file.getframerate()
        raw = file.readframes(file.getnframes())
    if width == 1:
        samples = (np.frombuffer(raw, dtype=np.uint8).astype(np.float64) - 128) / 128
    elif width in (2, 4):
        samples = np.frombuffer(raw, dtype=f"<i{width}").astype(np.float64) / float(1 << (8 * width - 1))
    else:
        raise ValueError(f"{8 * width} bit samples cannot be read")
    return rate, samples.reshape(-1, channels).mean(axis=1).astype(np.float32)


def encode(samples: np.ndarray, rate: int) -> bytes:
    """A mono 16 bit WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(2)
        file.setframerate(rate)
        file.writeframes((np.clip(samples, -1.0, 1.0) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def from_wav(rows: DataFrame, key: str = "path", seconds: float | None = None, to: int | None = None) -> DataFrame:
    """(key, rate, samples array<float>) of rows (key, content) that hold WAV files, the first seconds only and at the rate `to` if asked for."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for name, content in zip(pdf[key], pdf["content"], strict=True):
                rate, samples = decode(content)
                samples = samples[: int(seconds * rate)] if seconds else samples
                found.append((name, to, resampled(samples, rate, to).astype(np.float32)) if to else (name, rate, samples))
            yield pd.DataFrame(found, columns=[key, "rate", "samples"])

    return rows.select(key, "content").mapInPandas(work, f"{key} {rows.schema[key].dataType.simpleString()}, rate int, samples array<float>")


def read_wav(spark: SparkSession, path: str, seconds: float | None = None, to: int | None = None) -> DataFrame:
    """(path, rate, samples array<float>) of the WAV files below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return from_wav(files, seconds=seconds, to=to)


def as_wav(rows: DataFrame, key: str = "path") -> DataFrame:
    """(key, content): a WAV file as bytes for each row (key, rate, samples)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "content": [encode(np.asarray(s), int(r)) for s, r in zip(pdf["samples"], pdf["rate"], strict=True)]})

    return rows.select(key, "rate", "samples").mapInPandas(work, f"{key} {rows.schema[key].dataType.simpleString()}, content binary")
