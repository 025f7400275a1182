"""Mixing sources to target weights.

Each source's documents form one stream of words, cut into blocks of a fixed length. The sources'
shares of all slots follow from the weights; output shards draw their source counts from a multinomial
without replacement over those shares; the running slot number of a source goes through a
pseudorandom permutation of its block indices; slots and blocks meet by a join on the index.
Every draw and permutation is a function of the seed, so that reruns and lost executors change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vocalake.llm.common import mapped, materialised, word_count

BLOCK = 256
SLOTS = 1 << 14
#: Rows that share a running sum within a source's stream, about.
BUCKET_ROWS = 4096
SEED = 20240229


# ---------------------------------------------------------------- targets


def targets(sizes: list[int], weights: list[float], total: float, cap: float = 2.0) -> list[float]:
    """total shared by weight, none above cap times its size; what is cut off is shared anew among the rest."""
    out, open_, left = [0.0] * len(sizes), {k for k, s in enumerate(sizes) if s > 0}, float(total)
    while open_:
        weight = sum(weights[k] for k in open_)
        full = {k for k in open_ if left * weights[k] / weight >= cap * sizes[k]}
        if not full:
            for k in open_:
                out[k] = left * weights[k] / weight
            break
        for k in full:
            out[k] = cap * sizes[k]
        left -= sum(out[k] for k in full)
        open_ -= full
    return out


# ---------------------------------------------------------------- permutations and draws


def _round(x: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD1B54A32D192ED03)
        return (x ^ (x >> np.uint64(32))) & mask


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the indices: a four-round Feistel network, walked until inside."""
    if n <= 1:
        return np.zeros(len(index), dtype=np.int64)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for r in range(4):
            left, right = right, left ^ _round(right, key * 4 + r + 1, mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def position(block: int, n: int, key: int) -> int:
    """The index that the permutation maps to the block."""
    if n <= 1:
        return 0
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, x = np.uint64((1 << half) - 1), block
    while True:
        left, right = x >> half, x & int(mask)
        for r in reversed(range(4)):
            left, right = right ^ int(_round(np.array([left], dtype=np.uint64), key * 4 + r + 1, mask)[0]), left
        x = (left << half) | right
        if x < n:
            return x


def drawn(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each kind are among n things drawn without replacement, for any counts.

    Each thing is taken with chance n over all, as one binomial draw for each kind; what these are too many or too
    few is drawn again, from those taken or left, which is about the root of n. A few things are drawn one by one.
    """
    total = int(counts.sum())
    if 2 * n > total:
        return counts - drawn(counts, total - n, rng)
    out = np.zeros_like(counts)
    if n <= 16:
        for k in range(n):
            out[np.searchsorted(np.cumsum(counts - out), rng.integers(total - k), side="right")] += 1
        return out
    out = rng.binomial(counts, n / total)
    gap = n - int(out.sum())
    return out + drawn(counts - out, gap, rng) if gap >= 0 else out - drawn(out, -gap, rng)


def shard_counts(quota: np.ndarray, shard: int, slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source in the shard, slots of each source before it): shards are halved again and
    again, each half drawing its counts, so that a shard follows alone and all shards sum to the quota."""
    counts, before = quota.astype(np.int64), np.zeros(len(quota), dtype=np.int64)
    low, high = 0, -(-int(quota.sum()) // slots)
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.Generator(np.random.PCG64([seed, low, high]))
        first = drawn(counts, (middle - low) * slots, rng)
        if shard < middle:
            counts, high = first, middle
        else:
            counts, before, low = counts - first, before + first, middle
    return counts, before


@dataclass(frozen=True)
class Source:
    """blocks, passes over all of them, slots of the last pass, and words that the last slot leaves out."""

    number: int
    size: int
    blocks: int
    slots: int
    left_out: int


def planned(number: int, size: int, target: float, block: int, seed: int) -> Source:
    """Slots whose words add up to the target, rounded to a word and at most the cap of whole words."""
    wanted = min(round(target), 2 * size)
    if size <= 0 or wanted <= 0:
        return Source(number, size, -(-size // block), 0, 0)
    n = -(-size // block)
    passes, rest = divmod(wanted, size)
    short = block * n - size  # what the last block lacks
    at = position(n - 1, n, _key(seed, number, passes))
    slots = -(-rest // block)
    if at < slots and slots * block - short < rest:
        slots += 1
    words = slots * block - (short if at < slots else 0)
    if rest:
        return Source(number, size, n, passes * n + slots, words - rest)
    return Source(number, size, n, passes * n, 0)


def _key(seed: int, number: int, passes: int) -> int:
    return (seed * 1_000_003 + number) * 4_099 + passes


def draw_slots(shards: DataFrame, sources: list[Source], block: int = BLOCK, slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, source, block, take): a row per slot. shards has a column shard."""
    quota = np.array([s.slots for s in sources], dtype=np.int64)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for shard in batch.column(0).to_pylist():
                counts, before = shard_counts(quota, shard, slots, seed)
                for k, s in enumerate(sources):
                    j = before[k] + np.arange(counts[k], dtype=np.int64)
                    if not len(j):
                        continue
                    index = np.zeros(len(j), dtype=np.int64)
                    for turn in np.unique(j // s.blocks):
                        own = j // s.blocks == turn
                        index[own] = permuted(j[own] % s.blocks, s.blocks, _key(seed, s.number, int(turn)))
                    take = np.where(index == s.blocks - 1, s.size - (s.blocks - 1) * block, block)
                    take[j == s.slots - 1] -= s.left_out
                    arrays = [np.full(len(j), shard, dtype=np.int64), np.full(len(j), s.number, dtype=np.int32), index, take]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["shard", "source", "block", "take"])

    return mapped(shards.select("shard"), batches, "shard long, source int, block long, take long")


# ---------------------------------------------------------------- the operator


def streams(docs: DataFrame, source: str, key: str, text: str, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, list[tuple]]:
    """(key, hash, source, size, start) per row, start being its place in its source's stream, and (source, size) by code point, null last.

    The stream is ordered by a hash bucket, key, text hash and size. Running sums are made within each
    bucket and over the buckets' sums, so that a source with most rows is no single task; rows of one key and
    text are counted before, so that no more are they. The driver gets one row per source: sources are taken to
    be a set of names that fits it.
    """
    sized = docs.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), word_count(f"`{text}`").alias("size"),
        F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("hash"),
    )
    sized = materialised(sized, "sizes")
    found = [(r[0], r[1]) for r in sized.groupBy("source").agg(F.sum("size"), F.count("*")).collect()]
    rows = sized.count()
    found.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8")))  # UTF-8 sorts as code points do
    n = max(1, -(-rows // bucket_rows))
    sized = sized.groupBy("key", "source", "size", "hash").agg(F.count("*").alias("copies")).withColumn("bucket", F.pmod("hash", F.lit(n)))
    sums = sized.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("own"))
    sums = sums.withColumn("base", F.sum("own").over(W.partitionBy("source").orderBy("bucket")) - F.col("own")).drop("own")
    inner = W.partitionBy("bucket", "source").orderBy("key", "hash", "size")
    whole = F.col("size") * F.col("copies")
    placed = sized.repartition("bucket").withColumn("within", F.sum(whole).over(inner.rowsBetween(W.unboundedPreceding, 0)) - whole)
    sums = sums.withColumnsRenamed({"source": "of", "bucket": "at"})
    placed = placed.join(sums, (placed["bucket"] == sums["at"]) & placed["source"].eqNullSafe(sums["of"]))
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return placed.select("key", "hash", "source", "size", (F.col("base") + F.col("within") + F.col("copy") * F.col("size")).alias("start")), found


def mix(
    docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5, cap: float = 2.0, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(pieces, placed): what the mix takes, and every row with its size and its source's size and target.

    pieces: (shard, number, source, block, key, hash, start, size, from_word, to_word), a row per slot and document
    whose words it holds; from_word and to_word are places in the document. placed: (number, key, hash, source,
    size, start, source_size, target). Null and empty texts have size 0 and are never taken. Null sources are
    one source, the last. Repeated rows are taken each for itself. An empty table gives empty tables.
    """
    placed, found = streams(docs, source, key, text)
    names, sizes = [f[0] for f in found], [int(f[1] or 0) for f in found]
    shares = [weights[k % len(weights)] for k in range(len(names))]
    wanted = targets(sizes, shares, share * sum(sizes), cap)
    plan = [planned(k, s, t, block, seed) for k, (s, t) in enumerate(zip(sizes, wanted, strict=True))]
    spark = docs.sparkSession
    kind = docs.schema[source].dataType.simpleString()
    rows = [(name, p.number, s, float(t)) for name, p, s, t in zip(names, plan, sizes, wanted, strict=True)]
    table = spark.createDataFrame(rows, f"named {kind}, number int, source_size long, target double")
    placed = materialised(placed.join(table, placed["source"].eqNullSafe(table["named"])).drop("named"), "placed")
    total = sum(p.slots for p in plan)
    shards = spark.range(-(-total // slots)).withColumnRenamed("id", "shard")
    drawn = draw_slots(shards, plan, block, slots, seed).withColumnsRenamed({"source": "number"})
    whole = placed.filter("size > 0").select(
        "number", "source", "key", "hash", "start", "size",
        F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"),
    )
    # Spark takes the slots for as small as the list of shards and would broadcast them
    met = drawn.hint("merge").join(whole, ["number", "block"])
    low = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    high = F.least(F.col("block") * block + F.col("take") - F.col("start"), F.col("size"))
    pieces = met.select("shard", "number", "source", "block", "key", "hash", "start", "size", low.alias("from_word"), high.alias("to_word"))
    return pieces.filter("to_word > from_word"), placed


def taken(docs: DataFrame, **how) -> DataFrame:
    """(key, size, source_size, target, taken): a row per row of docs, with the words that the mix takes of it."""
    pieces, placed = mix(docs, **how)
    sums = pieces.groupBy("number", "start", "size").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    sums = sums.withColumnsRenamed({"number": "n", "start": "s", "size": "z"})
    out = placed.join(sums.hint("merge"), (placed["number"] == sums["n"]) & (placed["start"] == sums["s"]) & (placed["size"] == sums["z"]), "left")
    return out.select("key", "source", "start", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


_WORDS = re.compile("[^\x20\x09-\x0D]+")


def layers(spans: list[tuple[int, int, int]]) -> list[list[tuple[int, int]]]:
    """Spans (block, from, to) as texts to write: the k-th time a block is taken belongs to text k; neighbours are joined."""
    out: list[list[tuple[int, int]]] = []
    seen: dict[int, int] = {}
    for block, low, high in sorted(spans, key=lambda s: (s[0], -s[2])):
        k = seen[block] = seen.get(block, -1) + 1
        if k == len(out):
            out.append([])
        if out[k] and out[k][-1][1] == low:
            out[k][-1] = (out[k][-1][0], high)
        else:
            out[k].append((low, high))
    return out


def cut(text: str, runs: list[tuple[int, int]], size: int) -> str:
    """The runs of words with the white space inside them, one below the other; the text itself if that is all of it."""
    if runs == [(0, size)]:
        return text
    at = [m.span() for m in _WORDS.finditer(text)]
    return "\n".join(text[at[low][0] : at[high - 1][1]] for low, high in runs)


def mixed_documents(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", chars: str = "n_chars", **how) -> DataFrame:
    """The mix as documents: docs' columns, the text being the words taken, n_chars (if there) its length.

    A document taken twice gives two rows, one taken in part a row of that part, one not taken none.
    Rows that repeat key and text must have been removed before.
    """
    pieces, _ = mix(docs, source, key, text, **how)
    spans = pieces.groupBy("hash", "key", "size").agg(F.collect_list(F.struct("block", "from_word", "to_word")).alias("spans"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("h"))
    met = row.join(spans.hint("merge"), (row["h"] == spans["hash"]) & F.col(f"row.`{key}`").eqNullSafe(spans["key"]))
    met = met.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("size").alias("__size"), F.col("spans").alias("__spans"))
    names, at = docs.columns, docs.columns.index(text)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            rows, texts = [], []
            for k, (body, size, found) in enumerate(zip(*(batch.column(c).to_pylist() for c in (at, len(names), len(names) + 1)), strict=True)):
                for runs in layers([(s["block"], s["from_word"], s["to_word"]) for s in found]):
                    rows.append(k)
                    texts.append(cut(body, runs, size))
            columns = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[: len(names)]]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    out = mapped(met, batches, docs.schema)
    return out.withColumn(chars, F.length(text).cast(docs.schema[chars].dataType)) if chars in names else out
