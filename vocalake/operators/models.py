"""Slots for models that users bring: a loader per worker, batches in, columns out.

No model is bundled. A loader is a function without arguments that returns a callable from a list of
inputs to a list of outputs; it runs once per Python worker and name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalake.operators.joins import batches as grouped
from vocalake.operators.joins import cache_split
from vocalake.operators.kernels import spectral_denoise

Loader = Callable[[], Callable[[list], list]]
#: Kinds of slots and the type of their output.
SLOTS = {
    "denoise": "array<float>",
    "language": "struct<label: string, conf: double>",
    "transcribe": "string",
    "translate": "string",
    "synthesise": "array<float>",
    "embed": "array<float>",
    "spoof_score": "double",
    "phonemise": "string",
}
_LOADED: dict[str, Any] = {}


def loaded_or(loader: Loader, fallback: Callable[[list], list]) -> Loader:
    """A loader that gives the fallback where the model's library or files are missing."""

    def load() -> Callable[[list], list]:
        try:
            return loader()
        except (ImportError, OSError):
            return fallback

    return load


def pooled_vectors(vectors: list) -> list:
    """Mean and deviation of each vector at length 1: the embedding that needs no model."""
    out = []
    for v in vectors:
        v = np.asarray(v, dtype=np.float64)
        both = np.array([v.mean(), v.std()]) if len(v) else np.zeros(2)
        out.append((both / (np.linalg.norm(both) + 1e-9)).tolist())
    return out


def subtracted(clips: list) -> list:
    """Clips less the noise of their first frames: the denoiser that needs no model."""
    return [spectral_denoise(np.asarray(c, dtype=np.float64)).tolist() for c in clips]


def apply_model(rows: DataFrame, slot: str, loader: Loader, inputs: str, output: str, batch: int = 8) -> DataFrame:
    """rows with `output`, the model's result for each value of `inputs`, `batch` values at a time."""
    if slot not in SLOTS:
        raise ValueError(f"no slot {slot}; there are {', '.join(SLOTS)}")
    kind = SLOTS[slot]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{output}` {kind}"

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = f"{slot} {loader.__module__}.{loader.__qualname__}"
        if name not in _LOADED:
            _LOADED[name] = loader()
        for pdf in frames:
            found = [y for part in grouped(iter(pdf[inputs]), batch) for y in _LOADED[name](part)]
            yield pdf.assign(**{output: found})

    return rows.mapInPandas(work, schema)


def translated(sentences: DataFrame, cache: DataFrame, loader: Loader, key: str = "sentence", value: str = "translation", batch: int = 4) -> tuple[DataFrame, DataFrame]:
    """(sentences with their translation, the cache with what it lacked): only misses reach the model, each once."""
    _, misses = cache_split(sentences, cache, key, value)
    fresh = apply_model(misses, "translate", loader, key, value, batch)
    whole = cache.select(key, value).unionByName(fresh.select(key, value))
    return sentences.join(whole, key, "left"), whole


def rescored_candidates(candidates: DataFrame, by: str, acoustic: str, language: str) -> DataFrame:
    """The candidate of each segment with the best sum of scores, the first of equals by `ord`."""
    best = F.max_by(F.struct(*candidates.columns), F.struct(F.col(acoustic) + F.col(language), -F.col("ord"))).alias("best")
    return candidates.groupBy(by).agg(best).select("best.*")
