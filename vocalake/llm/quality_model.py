"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL, scored as sparse dot products.

N-grams are taken over two views of the words: as they are (one and two words), and as shapes (one to
three), in which runs of upper-case letters, lower-case letters and digits shrink to one sign and a
word equal to the one before is marked. Their hashes index one weight vector. A text's features are
its n-gram counts over their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalake.llm.common import mapped

DIMENSIONS = 1 << 18
#: Labelled rows that training takes, about: all, or a hash sample of this size of a larger table.
SAMPLE = 6000
THRESHOLD = 0.3
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-4, 1e-4, 3
#: Features are shares; this brings a typical product into the range of the logistic function.
SCALE = 8.0
TOGETHER = 2048

_RUNS = [(re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[a-zß-öø-ÿ]+"), "a"), (re.compile(r"[0-9]+"), "0"), (re.compile(r"(.)\1+"), r"\1")]


def shape(word: str) -> str:
    for pattern, sign in _RUNS:
        word = pattern.sub(sign, word)
    return word[:12]


def _mix(*parts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = parts[0] * np.uint64(0x9E3779B97F4A7C15)
        for part in parts[1:]:
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + part
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return ((out ^ (out >> np.uint64(31))) & np.uint64(DIMENSIONS - 1)).astype(np.int64)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index) of each n-gram of the texts and the n-grams per text; words are cut at ASCII white space."""
    split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    flat = split.flatten()
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy(zero_copy_only=False)
    full = np.array([bool(w) for w in words], dtype=bool)
    if len(words) and not full.all():  # white space at the ends of a text gives empty words
        keep = full[code]
        code, row = code[keep], row[keep]
    shapes: dict[str, int] = {}
    plain = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
    formed = np.array([shapes.get(s) or shapes.setdefault(s, xxhash.xxh64_intdigest(s)) for s in map(shape, words)], dtype=np.uint64)
    w, s = plain[code] if len(code) else plain[:0], formed[code] if len(code) else formed[:0]
    same = np.r_[False, (code[1:] == code[:-1]) & (row[1:] == row[:-1])] if len(code) else np.zeros(0, dtype=bool)
    s = np.where(same, s + np.uint64(1), s)
    two, three = row[1:] == row[:-1], row[2:] == row[:-2]
    grams = [
        (row, _mix(w)), (row[1:][two], _mix(w[:-1][two], w[1:][two])),
        (row, _mix(s ^ np.uint64(0x5A5A))), (row[1:][two], _mix(s[:-1][two] ^ np.uint64(0xA5A5), s[1:][two])),
        (row[2:][three], _mix(s[:-2][three] ^ np.uint64(0xC3C3), s[1:-1][three], s[2:][three])),
    ]
    rows, index = np.concatenate([g[0] for g in grams]), np.concatenate([g[1] for g in grams])
    return rows, index, np.bincount(rows, minlength=len(texts))


class Ftrl:
    """Follow-the-regularised-leader with a learning rate per coordinate."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        """One step on a row of distinct coordinates."""
        w = self.weights(at)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def trained(texts: list[str], labels: list[int]) -> np.ndarray:
    """DIMENSIONS weights and, last, the constant; rows are learned in the order given, EPOCHS times."""
    model, rows = Ftrl(DIMENSIONS + 1), []
    for low in range(0, len(texts), TOGETHER):
        row, index, total = features(texts[low : low + TOGETHER])
        order = np.argsort(row, kind="stable")
        parts = np.split(index[order], np.cumsum(total)[:-1])
        for part, label in zip(parts, labels[low : low + TOGETHER], strict=True):
            at, count = np.unique(part, return_counts=True)
            x = np.r_[SCALE * count / max(1, len(part)), 1.0]
            rows.append((np.r_[at, DIMENSIONS].astype(np.int32), x.astype(np.float32), float(label)))
    for _ in range(EPOCHS):
        for at, x, label in rows:
            model.learn(at, x.astype(np.float64), label)
    return model.weights().astype(np.float32)


def scores(texts: list[str], weights: np.ndarray) -> np.ndarray:
    row, index, total = features(texts)
    sums = np.bincount(row, weights=weights[index].astype(np.float64), minlength=len(texts))
    logit = SCALE * sums / np.maximum(total, 1) + float(weights[-1])
    return 1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35)))


def held_out(key: Column) -> Column:
    """Whether a row's label is never learned: crc32 of the key as text leaves no rest by 5; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights learned from about `sample` labelled rows that are not held out, in the order of a hash of the key.

    Labels other than 0 and 1 and keys without text rows are passed over; of a key's labels the larger
    and of its texts the smaller counts. Without a labelled row all weights are 0.
    """
    known = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y"))
    known = known.filter(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("k"))).groupBy("k").agg(F.max("y").alias("y"))
    n = known.count()
    if not n:
        return np.zeros(DIMENSIONS + 1, dtype=np.float32)
    order = F.pmod(F.xxhash64("k", F.lit("sample")), F.lit(1 << 30))
    if n > sample:
        known = known.filter(order < int((1 << 30) * (sample / n)))
    # at most about `sample` rows of two numbers go to all tasks
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).join(F.broadcast(known), "k")
    rows = rows.groupBy("k", "y").agg(F.min("t").alias("t")).withColumn("o", order)

    def learn(group: pa.Table) -> pa.Table:
        data = group.sort_by([("o", "ascending"), ("k", "ascending")])
        weights = trained(data.column("t").to_pylist(), data.column("y").to_pylist())
        return pa.table({"weights": pa.array([weights.tobytes()], pa.binary())})

    found = rows.withColumn("one", F.col("y") * 0).groupBy("one").applyInArrow(learn, "weights binary").collect()
    return np.frombuffer(found[0][0], dtype=np.float32) if found else np.zeros(DIMENSIONS + 1, dtype=np.float32)


def scored(docs: DataFrame, weights: np.ndarray, text: str = "text", to: str = "score") -> DataFrame:
    """docs' columns without the text, then the score (0 to 1). Null and empty texts have the constant's score.

    The weights (1 MB, whatever the corpus) are broadcast. Rows are scored each for itself; an empty
    table gives an empty table.
    """
    others = [f for f in docs.schema.fields if f.name != text]
    if to in {f.name for f in others}:
        raise ValueError(f"docs has a column {to}")
    at, schema = docs.columns.index(text), T.StructType([*others, T.StructField(to, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large in source:
            for low in range(0, large.num_rows, TOGETHER):
                batch = large.slice(low, TOGETHER)
                found = scores([x or "" for x in batch.column(at).to_pylist()], shared.value)
                kept = [c for k, c in enumerate(batch.columns) if k != at]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found)], schema.names)

    return mapped(docs, batches, schema)
