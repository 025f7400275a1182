"""Near duplicates by the exact Jaccard similarity of word shingles, among candidates of SimHash by covering masks.

A fingerprint has 64 bits in each of LONGS words, each set if most of the hashes of the shingle set have it. It is cut
into parts of WIDTH bits, and under one of a part's covering masks what differs in RADIUS of its bits has equal keys:
with radius 1 there are three masks, each without one third of the part, so that two texts meet in a part of which two
thirds agree. At a similarity of 0.8 a bit differs with chance p = acos(8/9) / pi = 0.151 at most, and a pair meets
in none of the 64 parts with chance (1 - 3 u^2 + 2 u^3)^64 for u = (1 - p)^8, 4 in a million. In a bucket of rows with
equal keys those go on that are near in the first two words, which a pair at 0.8 is not with chance 4 in ten million; the
rest has met by chance. Of sets of four and five shingles, whose bits differ more often, all pairs that differ in one
shingle meet.

Every link is counted on the whole shingle sets. Texts with equal sets are one node. The members of a group that has met
are first compared with its smallest node only; of the groups that this leaves in several components all pairs
between those are compared. These pairs are neither joined nor sent: nodes of a neighbourhood share a block of bounded
size, each two blocks that meet in a group meet once, with the fingerprints and groups of their nodes, and find the pairs
themselves. Either time whole fingerprints are compared first, and sets are made and sent only of nodes with a pair that is
within ALL bits, which one at 0.8 is not with chance 2 in ten billion at most (sets of up to five shingles are always
compared). Only spanning links leave the worker. Work grows with the square of a large group of texts that are neither
copies nor apart, in squares of blocks that are tasks of their own, and that of comparing fingerprints with the
square of a bucket, which holds a 65,536th of the nodes where these are unlike each other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalake.llm import simhash
from vocalake.llm.common import connected, mapped, materialised, run_starts, slices, unused, whole_runs

SHINGLE, SIMILARITY = 5, 0.8
#: Words of a fingerprint; bits of a part of it, and how many of them may differ at least.
LONGS, WIDTH, RADIUS = 24, 24, 1
#: Bits of the first word, and of the first two, in which a pair that has met may differ to be compared.
FIRST, BOTH = 26, 42
#: Bits of the whole fingerprint in which a pair may differ to be compared, and the size up to which sets are compared anyway.
ALL, SHORT = 340, 5
SEED = 42
_PIECE = 255
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text whose sets a worker makes at a time; shingles and nodes of a block of nodes, of which short texts reach
#: the second first; pairs that a worker holds at a time before they are cut to those that are left to compare.
TOGETHER, BLOCK, NODES, PAIRS = 1 << 20, 200_000, 2048, 1 << 20
#: Leading bits of a row's hash by which rows are passed over that are not wanted, before their texts are sent.
SIFT = 23


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the word shingles.

    A-Z count as lower case, words are cut at ASCII white space. Fewer words than a shingle make one
    shingle; no word (null, empty) makes none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) > shingle else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED, n)), dtype=np.uint64, count=n))


def set_print(hashes: np.ndarray, longs: int = LONGS) -> np.ndarray:
    """The majority bits of a set of hashes, in words that each take another hash of them; none of an empty set."""
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64)
    steps, ones = np.arange(1, longs + 1, dtype=np.uint64) * _STEP, np.zeros(64 * longs, dtype=np.int64)
    for start in range(0, len(hashes), _PIECE):  # as many as a byte can count
        words = simhash._mixed(hashes[start : start + _PIECE, None] + steps)
        ones += np.unpackbits(words.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def masks(longs: int = LONGS, width: int = WIDTH, radius: int = RADIUS) -> list[list[int]]:
    """The bits that each covering mask of each part keeps; bits short of a part at the end are in none."""
    parts = [list(range(low, low + width)) for low in range(0, 64 * longs - width + 1, width)]
    return [[b for b in part if mask >> b & 1] for part in parts for mask in simhash.covering_masks(part, radius)]


def bucket_keys(prints: np.ndarray, kept: list[list[int]]) -> np.ndarray:
    """Of each fingerprint (rows of words) a key for each mask: its place and the bits that it keeps, of which there are at most 40."""
    size = -(-max(map(len, kept)) // 8) * 8
    bits = np.unpackbits(prints.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
    bits = np.concatenate([bits, np.zeros((len(bits), 1), dtype=np.uint8)], axis=1)
    places = np.array([[*own, *[-1] * (size - len(own))] for own in kept])
    found = np.packbits(bits[:, places], axis=2).astype(np.int64)
    keys = np.broadcast_to(np.arange(len(kept)), found.shape[:2])
    for k in range(size // 8):
        keys = keys << 8 | found[:, :, k]
    return keys


def subset_keys(hashes: np.ndarray) -> np.ndarray:
    """Of a set of four or five hashes, keys of which two such sets share one if they differ in one hash that only one has."""
    subsets = [hashes] if len(hashes) == 4 else [np.delete(hashes, k) for k in range(5)] if len(hashes) == 5 else []
    return np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in subsets], dtype=np.uint64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *(r.view(np.int64) for r in rows)])))


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), dtype=np.int64).reshape(-1, 2)
    return found[:, 0].copy(), found[:, 1].copy()


def _row_hash(docs: DataFrame) -> Column:
    """A number that tells different rows apart."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)])


def prints(docs: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """(key, row, d0, d1, n, print, subsets): a hash of the row, a 128-bit digest of its shingle set, the set's size, its fingerprint
    and subset keys."""
    fields = [("key", docs.schema[key].dataType), *((name, T.LongType()) for name in ("row", "d0", "d1")), ("n", T.IntegerType())]
    fields += [(name, T.ArrayType(T.LongType())) for name in ("print", "subsets")]
    names = [name for name, _ in fields]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in source:
            for batch in slices(whole, 2, TOGETHER):
                sets = [shingle_set(x.as_py(), shingle) for x in batch.column(2)]
                sizes = np.array([len(s) for s in sets], dtype=np.int32)
                arrays = [batch.column(0), batch.column(1), *map(pa.array, _digests(sets)), pa.array(sizes)]
                yield pa.RecordBatch.from_arrays([*arrays, _lists([set_print(s) for s in sets]), _lists([subset_keys(s) for s in sets])], names)

    schema = T.StructType([T.StructField(name, kind) for name, kind in fields])
    return mapped(docs.select(F.col(f"`{key}`").alias("key"), _row_hash(docs).alias("row"), F.col(f"`{text}`").alias("text")), batches, schema)


def _nodes(found: DataFrame) -> DataFrame:
    """(id, d0, d1, n, row, least, print, subsets): one row per different set; least: its row with the smallest key, nulls last, then by hash."""
    order = F.struct(F.col("key").isNull().alias("none"), "key", F.col("row").alias("by"))
    nodes = found.groupBy("d0", "d1").agg(F.min(order).alias("least"), *(F.first(name).alias(name) for name in ("n", "print", "subsets")))
    return materialised(nodes.select(F.monotonically_increasing_id().alias("id"), "d0", "d1", "n", F.col("least.by").alias("row"), "least", "print", "subsets"), "nodes")


def _sifted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows (row, text) without most of those whose row is not wanted: a bit for each value of the first SIFT bits says whether one is."""
    at = f"shiftrightunsigned(row, {64 - SIFT})"
    words = wanted.groupBy(F.expr(f"shiftright({at}, 6)").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast({at} & 63 as int)))").alias("bits"))
    there = np.zeros(1 << (SIFT - 6), dtype=np.int64)
    for word, bits in words.collect():
        there[word] = bits
    there = there.view(np.uint64)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            own = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - SIFT)
            yield batch.filter(pa.array(there[own >> np.uint64(6)] >> (own & np.uint64(63)) & np.uint64(1) > 0))

    return mapped(rows, batches, rows.schema)


def _sets(docs: DataFrame, text: str, shingle: int, wanted: DataFrame) -> DataFrame:
    """(id, hashes) of the wanted nodes (id, d0, d1, row), made anew from the text of their row."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in source:
            for batch in slices(whole, 3, TOGETHER):
                sets = [shingle_set(x.as_py(), shingle) for x in batch.column(3)]
                d0, d1 = _digests(sets)
                same = (d0 == batch.column(1).to_numpy()) & (d1 == batch.column(2).to_numpy())
                kept = pa.RecordBatch.from_arrays([batch.column(0), _lists(sets)], ["id", "hashes"])
                yield kept.filter(pa.array(same))

    wanted = materialised(wanted, "wanted")
    rows = _sifted(docs.select(_row_hash(docs).alias("row"), F.col(f"`{text}`").alias("text")), wanted).join(wanted, "row")
    made = mapped(rows.select("id", "d0", "d1", "text"), batches, "id long, hashes array<long>")
    return materialised(made.dropDuplicates(["id"]), "sets")


# ---------------------------------------------------------------- meeting


def _bucketed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches (id, print) to (id, w0, w1, buckets)."""
    kept = masks()
    for whole in source:
        for low in range(0, whole.num_rows, 1024):
            batch = whole.slice(low, 1024)
            words = pc.list_flatten(batch.column(1)).to_numpy().view(np.uint64).reshape(-1, LONGS)
            arrays = [batch.column(0), *(pa.array(words[:, k].view(np.int64)) for k in range(2)), _lists(list(bucket_keys(words, kept)))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "w0", "w1", "buckets"])


def near_labels(start: np.ndarray, w0: np.ndarray, w1: np.ndarray, first: int = FIRST, both: int = BOTH) -> np.ndarray:
    """The first row of its group for each row: rows of a bucket are of one group if they are linked by rows that differ in few bits.

    start: the bucket's first row, of each row. A bucket is left as soon as it is one group.
    """
    size = len(start)
    end = np.searchsorted(start, start, "right")
    label, active, step = np.arange(size), np.arange(size), 1
    while len(active := active[active + step < end[active]]):
        other = active + step
        apart = np.bitwise_count(w0[active] ^ w0[other])
        near = np.flatnonzero(apart <= first)
        near = near[apart[near] + np.bitwise_count(w1[active[near]] ^ w1[other[near]]) <= both]
        one, two = label[active[near]], label[other[near]]
        if (one != two).any():
            while (one != two).any():
                np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
                while (label != (up := label[label])).any():
                    label = up
                one, two = label[one], label[two]
            groups = np.bincount(start, label == np.arange(size), minlength=size)
            active = active[groups[start[active]] > 1]
        step += 1
    return label


def _groups(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches (bucket, id, w0, w1) sorted by the first to (band, id): groups of two nodes or more, under a hash of their nodes."""
    for batch in whole_runs(source, 1):
        ids, (w0, w1) = batch.column(1).to_numpy(), (batch.column(k).to_numpy().view(np.uint64) for k in (2, 3))
        starts = run_starts(batch, 1)
        label = near_labels(np.repeat(starts[:-1], np.diff(starts)), w0, w1)
        met = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
        met = met[np.lexsort((ids[met], label[met]))]
        cuts = np.r_[0, np.flatnonzero(np.diff(label[met])) + 1, len(met)] if len(met) else np.zeros(1, dtype=np.int64)
        bands = [xxhash.xxh3_64_intdigest(ids[met[s:e]].tobytes()) for s, e in zip(cuts, cuts[1:], strict=False)]
        bands = np.repeat(np.array(bands, dtype=np.uint64).view(np.int64), np.diff(cuts))
        yield pa.RecordBatch.from_arrays([pa.array(bands), pa.array(ids[met])], ["band", "id"])


def _bands(nodes: DataFrame) -> DataFrame:
    """(band, id, n) of the nodes that meet others, once for each group of the same nodes."""
    dealt = mapped(nodes.filter("n > 0").select("id", "print"), _bucketed, "id long, w0 long, w1 long, buckets array<long>")
    dealt = dealt.select(F.explode("buckets").alias("bucket"), "id", "w0", "w1").repartition("bucket").sortWithinPartitions("bucket")
    met = materialised(mapped(dealt, _groups, "band long, id long").distinct(), "groups")
    return met.union(nodes.select(F.explode("subsets"), "id")).join(nodes.select("id", "n"), "id").select("band", "id", "n")


# ---------------------------------------------------------------- comparing

def _compared(ids: np.ndarray, sets: list[np.ndarray], asked: Iterable[tuple[int, np.ndarray]], similarity: float) -> tuple[list[int], list[int]]:
    """Spanning links among the pairs asked for: (place of a node, places of those to compare it with)."""
    sizes = np.array([len(s) for s in sets])
    border = np.r_[0, np.cumsum(sizes)]
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    mask, label = np.zeros(int(codes.max(initial=0)) + 1, dtype=bool), list(range(len(ids)))
    links: tuple[list[int], list[int]] = ([], [])

    def root(k: int) -> int:
        while label[k] != k:
            label[k] = label[label[k]]
            k = label[k]
        return k

    for k, others in asked:
        partners = np.array([p for p in others.tolist() if root(p) != root(k)], dtype=np.int64)
        if not len(partners):
            continue
        mask[codes[border[k] : border[k + 1]]] = True
        if 4 * len(partners) < len(ids):
            both = np.array([np.count_nonzero(mask[codes[border[p] : border[p + 1]]]) for p in partners])
        else:
            both = np.add.reduceat(mask[codes].astype(np.int32), border[:-1])[partners]
        mask[codes[border[k] : border[k + 1]]] = False
        for p in partners[both / (sizes[k] + sizes[partners] - both) >= similarity].tolist():
            if (one := root(k)) != (other := root(p)):
                label[max(one, other)] = min(one, other)
                links[0].append(int(ids[k]))
                links[1].append(int(ids[p]))
    return links


def near_prints(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the fingerprints (rows of words, the size of the set last) are near one, or are of sets too small to tell."""
    apart = np.bitwise_count((others[:, :-1] ^ one[:-1]).view(np.uint64)).sum(axis=1, dtype=np.int64)  # of signed numbers it counts the absolute value's
    return (apart <= ALL) | (np.minimum(others[:, -1], one[-1]) <= SHORT)


def _near(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches (low, high, kind, id, longs) sorted by the first two to (low, high, a, b): kind 0 has the fingerprints of nodes,
    kind 1 the nodes that one is to be compared with, of which those that are near it are kept."""
    for batch in whole_runs(source, 2):
        kind, ids, longs = batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4)
        border, flat = longs.offsets.to_numpy(), longs.values.to_numpy()
        starts, asking, kept = run_starts(batch, 2), [], []
        for low, high in zip(starts, starts[1:], strict=False):
            rows = np.arange(low, high)
            own = rows[kind[low:high] == 0]
            at, prints = {x: k for k, x in enumerate(ids[own].tolist())}, np.array([flat[border[r] : border[r + 1]] for r in own])
            for r in rows[kind[low:high] == 1]:
                others = flat[border[r] : border[r + 1]]
                others = others[near_prints(prints[at[int(ids[r])]], prints[[at[x] for x in others.tolist()]])]
                if len(others):
                    asking.append(r)
                    kept.append(others)
        place = pa.array(np.array(asking, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(place) for k in (0, 1, 3)), _lists(kept)], ["low", "high", "a", "b"])


def _linked(similarity: float):
    """Arrow batches (low, high, kind, id, longs) sorted by the first two to spanning links (a, b): kind 0 has the sets of nodes,
    kind 1 the nodes that one is to be compared with."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_runs(source, 2):
            kind, ids, longs = batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4)
            border, flat = longs.offsets.to_numpy(), longs.values.to_numpy()
            starts, out = run_starts(batch, 2), ([], [])
            for low, high in zip(starts, starts[1:], strict=False):
                rows = np.arange(low, high)
                own, asking = rows[kind[low:high] == 0], rows[kind[low:high] == 1]
                at = {x: k for k, x in enumerate(ids[own].tolist())}
                asked = ((at[int(ids[r])], np.array([at[x] for x in flat[border[r] : border[r + 1]].tolist()])) for r in asking)
                links = _compared(ids[own], [flat[border[r] : border[r + 1]] for r in own], asked, similarity)
                for column, more in zip(out, links, strict=True):
                    column += more
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b"])

    return batches


def _grid(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the two, in parts of about PAIRS."""
    step = max(1, PAIRS // max(1, len(right)))
    for start in range(0, len(left), step):
        part = left[start : start + step]
        yield np.repeat(part, len(right)), np.tile(right, len(part))


def _met_pairs(band: np.ndarray, at: np.ndarray, first: np.ndarray, root: np.ndarray, n: np.ndarray, within: bool, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """(place, later places) of the nodes that share a bucket, are of different components and of sizes that allow the similarity.

    band, at: the bucket keys of nodes; first: whether a node is of the first block; within: whether there is only one.
    """
    order = np.argsort(band, kind="stable")
    band, at, size = band[order], at[order], len(root)
    cuts = np.r_[0, np.flatnonzero(band[1:] != band[:-1]) + 1, len(band)]
    found, held = [], 0
    for low, high in zip(cuts, cuts[1:], strict=False):
        own = at[low:high]
        if len(own) < 2 or (root[own] == root[own[0]]).all():
            continue
        for x, y in _grid(own, own) if within else _grid(own[first[own]], own[~first[own]]):
            fit = (root[x] != root[y]) & (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-6)
            fit &= (x < y) | (not within)
            found.append(np.minimum(x, y)[fit] * size + np.maximum(x, y)[fit])
            held += len(found[-1])
            if held > 2 * PAIRS:
                found = [np.unique(np.concatenate(found))]
                held = 0
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
    one, other = pairs // size, pairs % size
    cuts = np.r_[0, np.flatnonzero(one[1:] != one[:-1]) + 1, len(one)] if len(one) else np.zeros(1, dtype=np.int64)
    for low, high in zip(cuts, cuts[1:], strict=False):
        yield int(one[low]), other[low:high]


def _near_pairs(batch: pa.RecordBatch, s: int, e: int, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """What _met_pairs finds in rows s to e (low, high, block, id, n, root, bands, print) of one pair of blocks, if it is near."""
    low, high, block, _, n, root = (batch.column(k).slice(s, e - s).to_numpy() for k in range(6))
    bands, prints = (batch.column(k).slice(s, e - s) for k in (6, 7))
    at = np.repeat(np.arange(e - s), np.diff(bands.offsets.to_numpy()))
    prints = prints.flatten().to_numpy().reshape(e - s, -1)
    for k, others in _met_pairs(bands.flatten().to_numpy(), at, block == low[0], root, n, low[0] == high[0], similarity):
        if len(others := others[near_prints(prints[k], prints[others])]):
            yield k, others


def _near_nodes(similarity: float):
    """Arrow batches (low, high, block, id, n, root, bands, print) sorted by the first two to (low, high, id) of what has a near pair in them."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_runs(source, 2):
            starts, has = run_starts(batch, 2), np.zeros(batch.num_rows, dtype=bool)
            for s, e in zip(starts, starts[1:], strict=False):
                for k, others in _near_pairs(batch, s, e, similarity):
                    has[s + k] = has[s + others] = True
            yield batch.select([0, 1, 3]).filter(pa.array(has))

    return batches


def _linked_blocks(similarity: float):
    """Arrow batches (low, high, block, id, n, root, bands, print, hashes) sorted by the first two to spanning links (a, b) of what meets in them."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_runs(source, 2):
            ids, hashes = batch.column(3).to_numpy(), batch.column(8)
            ends, sets = hashes.offsets.to_numpy(), hashes.values.to_numpy()
            starts, out = run_starts(batch, 2), ([], [])
            for s, e in zip(starts, starts[1:], strict=False):
                asked = _near_pairs(batch, s, e, similarity)
                links = _compared(ids[s:e], [sets[ends[r] : ends[r + 1]] for r in range(s, e)], asked, similarity)
                for column, more in zip(out, links, strict=True):
                    column += more
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b"])

    return batches


def _by_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("low", "high").sortWithinPartitions("low", "high")


def _with_own(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Rows (low, high, a, b) of a node and its partners, with a row (id, longs) of each node once for each two blocks that need it."""
    wanted = mapped(_by_blocks(pairs), _named, "low long, high long, id long")
    own = wanted.join(own, "id").select("low", "high", F.lit(0).alias("kind"), "id", "longs")
    return _by_blocks(own.union(pairs.select("low", "high", F.lit(1), "a", "b")))


def _named(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair rows sorted by (low, high) to the nodes in them, once for each two blocks."""
    for batch in whole_runs(source, 2):
        low, high, a, lists = batch.column(0), batch.column(1), batch.column(2).to_numpy(), batch.column(3)
        border, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        starts = run_starts(batch, 2)
        found = [np.unique(np.r_[a[s:e], flat[border[s] : border[e]]]) for s, e in zip(starts, starts[1:], strict=False)]
        row = pa.array(np.repeat(starts[:-1], [len(f) for f in found]))
        yield pa.RecordBatch.from_arrays([low.take(row), high.take(row), pa.array(np.concatenate(found))], ["low", "high", "id"])


def _roots(docs: DataFrame, text: str, nodes: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(node, root) of the nodes that link to another."""
    rows = _bands(nodes)
    hubs = rows.groupBy("band").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("members")).filter("members > 1")
    met = materialised(rows.join(hubs, "band").select("band", "id", "n", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")), "met")
    anchored = met.groupBy("id").agg(F.min("hub").alias("anchor"), F.first("n").alias("n"))
    blocks = anchored.groupBy("anchor").agg(F.ceil(F.greatest(F.sum("n") / BLOCK, F.count("*") / NODES)).alias("parts"))
    blocks = anchored.join(blocks, "anchor").select("id", F.xxhash64("anchor", F.pmod(F.xxhash64("id"), F.greatest("parts", F.lit(1)))).alias("block"))
    blocks = materialised(blocks, "blocks")
    known = nodes.select("id", "d0", "d1", "row")
    whole = nodes.select("id", F.concat("print", F.array(F.col("n").cast("long"))).alias("longs"))

    fit = F.least("n", "hub_n") >= F.lit(similarity) * F.greatest("n", "hub_n") - 1e-6
    first = met.filter("id <> hub").filter(fit).select("id", "hub").distinct()
    first = first.join(blocks, "id").join(blocks.select(F.col("id").alias("hub"), F.col("block").alias("hub_block")), "hub")
    first = first.groupBy(F.least("block", "hub_block").alias("low"), F.greatest("block", "hub_block").alias("high"), F.col("id").alias("a")).agg(F.collect_list("hub").alias("b"))
    first = _with_own(materialised(first, "hub-pairs"), whole)
    first = materialised(mapped(first, _near, "low long, high long, a long, b array<long>"), "hub-near")
    sets = _sets(docs, text, shingle, first.select(F.explode(F.concat("b", F.array("a"))).alias("id")).distinct().join(known, "id"))
    links = _with_own(first, sets.withColumnRenamed("hashes", "longs"))
    links = materialised(mapped(links, _linked(similarity), "a long, b long"), "hub-links")
    joined = connected(links, "hub-components")

    left = met.select("band", "id", "n").join(joined, met["id"] == joined["node"], "left").join(blocks, "id")
    left = materialised(left.select("band", "id", "n", F.coalesce("root", "id").alias("root"), "block"), "left")
    there = left.groupBy("band").agg((F.min("root") < F.max("root")).alias("split"), F.sort_array(F.collect_set("block")).alias("there"))
    left = left.join(there.filter("split").drop("split"), "band").groupBy("id").agg(
        *(F.first(name).alias(name) for name in ("block", "n", "root")), F.collect_list("band").alias("bands"), F.array_distinct(F.flatten(F.collect_set("there"))).alias("others")
    )
    left = materialised(left.join(whole, "id"), "rest")
    pair = (F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    near = left.withColumn("other", F.explode("others")).select(*pair, "block", "id", "n", "root", "bands", "longs")
    near = materialised(mapped(_by_blocks(near), _near_nodes(similarity), "low long, high long, id long"), "rest-near")
    more = near.select("id").distinct().join(sets.select("id"), "id", "left_anti")
    sets = sets.union(_sets(docs, text, shingle, more.join(known, "id")))
    rows = near.join(left, "id").join(sets, "id").select("low", "high", "block", "id", "n", "root", "bands", "longs", "hashes")
    rest = materialised(mapped(_by_blocks(rows), _linked_blocks(similarity), "a long, b long"), "rest-links")
    return connected(links.union(rest), "shingle-components")


def _named_roots(docs: DataFrame, text: str, nodes: DataFrame, similarity: float, shingle: int) -> DataFrame:
    roots = _roots(docs, text, nodes, similarity, shingle)
    return nodes.select("id", "d0", "d1", "least").join(roots, nodes["id"] == roots["node"], "left").select("d0", "d1", "least", F.coalesce("root", "id").alias("root"))


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(key, component_id) for each row of docs: the smallest key that it reaches by links of at least that similarity.

    Texts without a word are alike. Repeated rows give repeated rows; null keys count as larger than any,
    and a component of null keys only has a null id. An empty table gives an empty table; columns of
    docs may have any names. Texts are compared whole, however long.
    """
    found = materialised(prints(docs, key, text, shingle), "shingles")
    named = _named_roots(docs, text, _nodes(found), similarity, shingle)
    reached = named.groupBy("root").agg(F.min("least").alias("first"))
    named = named.join(reached, "root").select("d0", "d1", F.col("first.key").alias("component_id"))
    return found.select("key", "d0", "d1").join(named, ["d0", "d1"]).select("key", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each component, in docs' columns: that with the smallest key, null keys last, ties to the smaller hash
    of the row, so that reruns keep the same. Only numbers of the kept rows meet the table again, once."""
    named = _named_roots(docs, text, _nodes(prints(docs, key, text, shingle)), similarity, shingle)
    row = unused("row_hash", docs.columns)
    kept = materialised(named.groupBy("root").agg(F.min("least").alias("first")).select(F.col("first.by").alias(row)), "kept")
    return docs.withColumn(row, _row_hash(docs)).join(kept, row, "left_semi").dropDuplicates([row]).drop(row)
