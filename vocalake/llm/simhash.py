"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints that differ in at most r of the bits p get equal keys under at least one of 2^(r+1) - 1
masks over p: each bit gets a non-zero vector of r + 1 bits, mask v keeps the bits whose vector has an
odd product with v, and r vectors cannot span the space, so that some v is orthogonal to all of those
of the differing bits. With several parts of the bits, a pair within the radius is within its share of
the radius in one part. Buckets are ranges of sorted keys; only spanning links leave a bucket, and
components are joined by distributed star steps.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalake.llm.common import connected, mapped, materialised, unused

#: Buckets above this size are dealt anew by further masks over their free bits.
BUCKET = 1024
SEED = 42


@dataclass(frozen=True)
class Plan:
    """shingle: words; longs: 64-bit words of a fingerprint; radius: bits of the first word that may
    differ; parts: into which it is cut for the masks; total: bits of the whole fingerprint that may differ."""

    shingle: int = 3
    longs: int = 1
    radius: int = 2
    parts: int = 1
    total: int = 2


# ---------------------------------------------------------------- fingerprints

#: bits of each byte value
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = np.arange(8, dtype=np.int64) * 256
_PIECE = 1 << 16


def _counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from histograms of their bytes."""
    cells = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8) + _LANES
    return (np.bincount(cells.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """A second hash of each hash."""
    with np.errstate(over="ignore"):
        x = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, shingle: int = 3, longs: int = 1) -> list[int]:
    """The majority bits of XXH64 (seed 42) over the word shingles, repeats included.

    A-Z count as lower case, words are cut at ASCII white space. Fewer words than a shingle make one
    shingle; no word (null, empty) gives zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return [0] * longs
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) > shingle else iter([b" ".join(words)])
    ones = np.zeros((longs, 64), dtype=np.int64)
    for start in range(0, n, _PIECE):
        size = min(_PIECE, n - start)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED, size)), dtype=np.uint64, count=size)
        for k in range(longs):
            ones[k] += _counts(hashes)
            hashes = _mixed(hashes)
    return [int.from_bytes(np.packbits(row * 2 > n, bitorder="little").tobytes(), "little") for row in ones]


def fingerprints(docs: DataFrame, key: str, text: str, plan: Plan) -> DataFrame:
    """(key, w0, w1): the key column and the fingerprint as signed longs; w1 is 0 where there is one long."""
    field = T.StructField("key", docs.schema[key].dataType)
    schema = T.StructType([field, T.StructField("w0", T.LongType()), T.StructField("w1", T.LongType())])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = [fingerprint(x.as_py(), plan.shingle, plan.longs) for x in batch.column(1)]
            w0 = np.array([r[0] for r in rows], dtype=np.uint64).view(np.int64)
            w1 = np.array([r[1] if plan.longs > 1 else 0 for r in rows], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w0), pa.array(w1)], ["key", "w0", "w1"])

    return mapped(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), batches, schema)


# ---------------------------------------------------------------- masks


def covering_masks(bits: list[int], radius: int, seed: int = 7) -> list[int]:
    """2^(radius+1) - 1 masks over the bits, such that any `radius` bits are outside one of them."""
    order = random.Random(seed).sample(bits, len(bits))
    vectors = 2 ** (radius + 1)
    given = {bit: 1 + k % (vectors - 1) for k, bit in enumerate(order)}
    return [sum(1 << bit for bit in bits if (given[bit] & v).bit_count() & 1) for v in range(1, vectors)]


def first_masks(plan: Plan) -> list[tuple[int, list[int]]]:
    """(mask, bits of its part that it leaves free)."""
    out = []
    for k in range(plan.parts):
        part = list(range(64 * k // plan.parts, 64 * (k + 1) // plan.parts))
        for mask in covering_masks(part, plan.radius // plan.parts):
            out.append((mask, [b for b in part if not mask >> b & 1]))
    return out


def refined_masks(masks: list[tuple[int, list[int]]], radius: int) -> list[tuple[int, list[int]]]:
    """For each mask, its children: they also keep some of its free bits, and cover what it has left."""
    out = []
    for mask, free in masks:
        for more in covering_masks(free, radius):
            out.append((mask | more, [b for b in free if not more >> b & 1]))
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


# ---------------------------------------------------------------- buckets


def _spanning(start: np.ndarray, w0: np.ndarray, w1: np.ndarray, radius: int, total: int) -> tuple[list[int], list[int]]:
    """Links that join what is within the radius in each bucket; start: the bucket's first row, of each row."""
    n = len(start)
    end = np.r_[np.flatnonzero(np.diff(start)) + 1, n] if n else np.zeros(0, dtype=np.int64)
    end = np.repeat(end, np.diff(np.r_[0, end]))
    label = np.arange(n)
    left, right = [], []

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    active, step = np.arange(n), 1
    while True:
        active = active[active + step < end[active]]
        if not len(active):
            return left, right
        other = active + step
        apart = np.bitwise_count(w0[active] ^ w0[other])
        near = apart <= radius
        if near.any():
            i, j = active[near], other[near]
            whole = apart[near] + np.bitwise_count(w1[i] ^ w1[j])
            fits = (whole <= total) & (label[i] != label[j])
            for a, b in zip(i[fits].tolist(), j[fits].tolist(), strict=True):
                ra, rb = root(a), root(b)
                if ra != rb:
                    label[max(ra, rb)] = min(ra, rb)
                    left.append(a)
                    right.append(b)
            if fits.any():  # every row points to its root again
                while (label != (up := label[label])).any():
                    label[:] = up
        step += 1


def _bucket_links(plan: Plan, most: int | None):
    """Arrow batches of rows sorted by (mask, bits) to links (kind 0) and, beyond `most` rows, the bucket's rows (kind 1)."""

    def out(kind: int, mask: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array(np.full(len(a0), kind, dtype=np.int32)), pa.array(mask.astype(np.int32))]
        arrays += [pa.array(x.astype(np.uint64).view(np.int64)) for x in (a0, a1, b0, b1)]
        return pa.RecordBatch.from_arrays(arrays, ["kind", "mask", "a0", "a1", "b0", "b1"])

    def work(mask: np.ndarray, bits: np.ndarray, w0: np.ndarray, w1: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(mask):
            return
        new = np.r_[True, (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(mask)])
        start, sizes = np.repeat(first, size), np.repeat(size, size)
        hot = sizes > most if most else np.zeros(len(mask), dtype=bool)
        keep = np.flatnonzero(~hot & (sizes > 1))
        if len(keep):
            left, right = _spanning(start[keep], w0[keep], w1[keep], plan.radius, plan.total)
            i, j = keep[left], keep[right]
            if len(i):
                yield out(0, mask[i], w0[i], w1[i], w0[j], w1[j])
        if hot.any():
            yield out(1, mask[hot], w0[hot], w1[hot], w0[hot], w1[hot])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        passing = None  # the bucket found hot, whose rows go on as they come
        for batch in source:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            cols = [cols[0], cols[1], cols[2].view(np.uint64), cols[3].view(np.uint64)]
            if passing is not None:
                same = int(((cols[0] == passing[0]) & (cols[1] == passing[1])).sum())  # a prefix, by the order
                if same:
                    m, _, w0, w1 = (c[:same] for c in cols)
                    yield out(1, m, w0, w1, w0, w1)
                    cols = [c[same:] for c in cols]
                if not len(cols[0]):
                    continue
                passing = None
            held.append(tuple(cols))
            last = int(np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))[-1]) + 1 if (cols[0][0], cols[1][0]) != (cols[0][-1], cols[1][-1]) else 0
            if last:
                whole = [np.concatenate([h[k] for h in held[:-1]] + [held[-1][k][:last]]) for k in range(4)]
                held = [tuple(c[last:] for c in held[-1])]
                yield from work(*whole)
            elif len(held) > 1:  # the batch is of one bucket; what is held before it may end with others
                whole = [np.concatenate([h[k] for h in held]) for k in range(4)]
                cut = int(np.flatnonzero((whole[0] != whole[0][-1]) | (whole[1] != whole[1][-1]))[-1]) + 1 if (whole[0][0], whole[1][0]) != (whole[0][-1], whole[1][-1]) else 0
                yield from work(*(c[:cut] for c in whole))
                held = [tuple(c[cut:] for c in whole)]
            if most and len(held[0][0]) > most:
                m, b, w0, w1 = held[0]
                passing = (m[-1], b[-1])
                yield out(1, m, w0, w1, w0, w1)
                held = []
        if held:
            yield from work(*(np.concatenate([h[k] for h in held]) for k in range(4)))

    return batches


def links(distinct: DataFrame, plan: Plan, bucket: int = BUCKET) -> DataFrame:
    """(a0, a1, b0, b1): spanning links between distinct fingerprints (w0, w1) within the plan's radius.

    With one part and a radius up to 2, a bucket above `bucket` rows goes through further masks over
    the bits that its mask leaves free, until at most 2^5 fingerprints can share a bucket.
    """
    masks, levels = first_masks(plan), 3 if plan.parts == 1 and plan.radius <= 2 else 1
    rows, found = distinct.select("w0", "w1", F.posexplode(F.array(*[F.col("w0").bitwiseAND(F.lit(_signed(m))) for m, _ in masks])).alias("mask", "bits")), None
    schema = "kind int, mask int, a0 long, a1 long, b0 long, b1 long"
    for level in range(1, levels + 1):
        most = bucket if level < levels else None
        dealt = rows.select("mask", "bits", "w0", "w1").repartition("mask", "bits").sortWithinPartitions("mask", "bits")
        done = materialised(mapped(dealt, _bucket_links(plan, most), schema), "buckets")
        here = done.filter("kind = 0").select("a0", "a1", "b0", "b1")
        found = here if found is None else found.union(here)
        hot = done.filter("kind = 1")
        if most is None or not hot.take(1):
            break
        fan = 2 ** (plan.radius + 1) - 1
        masks = refined_masks(masks, plan.radius)
        table = F.array(*[F.lit(_signed(m)) for m, _ in masks])
        children = hot.select(F.col("a0").alias("w0"), F.col("a1").alias("w1"), F.explode(F.sequence(F.col("mask") * fan, F.col("mask") * fan + fan - 1)).alias("mask"))
        rows = children.withColumn("bits", F.col("w0").bitwiseAND(F.element_at(table, F.col("mask") + 1)))
    return found


# ---------------------------------------------------------------- the operator


def _hex(w0: str, w1: str, longs: int):
    shown = F.lower(F.lpad(F.hex(w0), 16, "0"))
    return F.concat(shown, F.lower(F.lpad(F.hex(w1), 16, "0"))) if longs > 1 else shown


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", plan: Plan = Plan()) -> DataFrame:
    """(key, fingerprint, component_id) for each row of docs: its hex fingerprint and the smallest key it reaches.

    Equal fingerprints are one node, so that copies are never paired. Null and empty texts have the
    fingerprint zero and link like any other. Repeated rows give repeated rows. Null keys count as
    larger than any; a component of null keys only has a null id. An empty table gives an empty table;
    other columns of docs are not looked at, whatever their names.
    """
    prints = materialised(fingerprints(docs, key, text, plan), "fingerprints")
    nodes = prints.groupBy("w0", "w1").agg(F.min("key").alias("least"))
    edges = links(nodes.select("w0", "w1"), plan)
    edges = edges.select(_hex("a0", "a1", plan.longs).alias("a"), _hex("b0", "b1", plan.longs).alias("b"))
    stars = connected(edges, "simhash")
    nodes = nodes.withColumn("fingerprint", _hex("w0", "w1", plan.longs))
    linked = nodes.join(stars, nodes["fingerprint"] == stars["node"], "left")
    linked = linked.withColumn("root", F.coalesce("root", "fingerprint"))
    least = linked.filter(F.col("node").isNotNull()).groupBy("root").agg(F.min("least").alias("reached"))
    linked = linked.join(least, "root", "left").select("w0", "w1", "fingerprint", F.coalesce("reached", "least").alias("component_id"))
    return prints.join(linked, ["w0", "w1"]).select("key", "fingerprint", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", plan: Plan | None = None) -> DataFrame:
    """docs with one row of each component, that with the smallest key, in docs' columns.

    Components are those of `shingles` (see its keep_one), or with a plan those of its fingerprints; then of rows that repeat
    a key the one with the smallest hash stays, and of rows without a key one of each text.
    """
    if plan is None:
        from vocalake.llm import shingles  # which takes the masks from here

        return shingles.keep_one(docs, key, text)
    named = docs.filter(F.col(f"`{key}`").isNotNull())
    kept, place = unused("kept_key", docs.columns), unused("place", docs.columns)
    last = components(named, key, text, plan).filter(F.col("key") == F.col("component_id")).select(F.col("key").alias(kept)).distinct()
    first = F.row_number().over(W.partitionBy(key).orderBy(F.xxhash64(*docs.columns)))
    stay = named.join(last, named[key] == last[kept], "left_semi").withColumn(place, first).filter(F.col(place) == 1).drop(place)
    return stay.unionByName(docs.filter(F.col(f"`{key}`").isNull()).dropDuplicates([text]))
