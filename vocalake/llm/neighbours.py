"""Approximate nearest neighbours by shifted space-filling curves.

Each of several Hilbert curves orders all vectors by a rotated, shifted projection of their
directions. Spark range-partitions the rows of every curve; a query's candidates are the rows within
a window around its place on each curve. Windows are cut into blocks of rows, each block keeps the
best of a query's window, and the blocks' best are merged and ranked by the exact inner product.

Equal vectors are one place on the curves: only distinct vectors are ordered and searched, and each one
found stands for the k + 1 smallest keys that hold it, more of which no answer can hold. So a group of
equal vectors, however large, costs one row on each curve and its ties are exact. A key that has several
vectors is a place of its own for each of them, and counts once among the candidates of a query. Places
travel as numbers; the vectors join them once, where they are compared.

The window is a share of the rows. On vectors without structure, such as random directions, a recall
of 0.9 takes about half of all pairs whatever the order, so that a window of fixed size would lose
recall as the table grows; on clustered vectors a smaller share does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vocalake.llm.common import mapped, materialised

CURVES, DIMS, BITS = 32, 8, 7
#: Rows before and behind a query on each curve: this share of all, at least LEAST_WINDOW.
WINDOW, LEAST_WINDOW = 0.013, 64
BLOCK = 2048
SEED = 11


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of integer cells (n, d), in d * bits bits.

    By Skilling's transposed form: undo the rotations from the highest bit down, take the Gray code,
    then interleave the bits.
    """
    x = cells.T.astype(np.int64).copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(d):
            set_ = (x[i] & bit) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
    x[1:] ^= np.bitwise_xor.accumulate(x[:-1], axis=0) if d > 1 else 0
    carry = np.zeros(x.shape[1], dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        carry ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    x ^= carry
    key = np.zeros(x.shape[1], dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def _curve(number: int, dim: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(projection (dim, dims), shift in cells' widths) of a curve."""
    rng = np.random.Generator(np.random.PCG64([seed, number]))
    base, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
    return base[:, :dims], rng.uniform(0.0, 0.25, dims)


def keys_on(vectors: np.ndarray, number: int, dims: int = DIMS, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Keys of unit vectors on a curve; a projection's spread is 1 / sqrt(dim)."""
    dim = vectors.shape[1]
    dims = min(dims, dim)
    base, shift = _curve(number, dim, dims, seed)
    inside = 0.5 + (vectors @ base) * np.sqrt(dim) / 6.0  # three spreads to either side
    cells = np.floor((inside * 0.75 + shift) * (1 << bits)).astype(np.int64)
    return hilbert_keys(np.clip(cells, 0, (1 << bits) - 1), bits)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, no null or non-finite component, not zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _best(scores: np.ndarray, lows: np.ndarray, most: int, margin: float) -> np.ndarray:
    """Places of all that can be among the best with `most` different keys, by scores that may be off by half the margin; -inf is none."""
    near = np.flatnonzero(scores > -np.inf)
    take = 2 * most
    while take < len(near):
        least = np.partition(scores[near], len(near) - take)[len(near) - take]
        if len(np.unique(lows[near[scores[near] >= least]])) >= most:
            return near[scores[near] >= least - margin]
        take *= 2
    return near


def _distinct(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The places of rows (id, v, asks), and (query_id, asker) of the rows that ask.

    Places: (gid, v, own, low, ids, asks), a row for each different vector with its smallest key, its `most` smallest keys,
    and whether any row of it asks. A key with several vectors has places of its own (own is the key).
    """
    each = rows.groupBy("id", "v").agg(F.max("asks").alias("asks"))
    several = each.groupBy("id").count().filter("count > 1").select(F.col("id").alias("own"))
    each = each.join(several, each["id"] == several["own"], "left")
    first = F.row_number().over(W.partitionBy("v", "own").orderBy("id"))
    small = each.select("v", "own", "id").withColumn("place", first).filter(F.col("place") <= most)
    small = small.groupBy("v", "own").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    asking = each.filter("asks").select(F.col("v").alias("w"), F.col("own").alias("by"), F.col("id").alias("query_id"))
    asked = asking.select("w", "by").distinct().withColumn("asks", F.lit(True))
    whole = small.join(asked, (F.col("v") == F.col("w")) & F.col("own").eqNullSafe(F.col("by")), "left")
    whole = whole.select("v", "own", F.col("ids")[0].alias("low"), "ids", F.coalesce("asks", F.lit(False)).alias("asks"))
    places = materialised(whole.select(F.monotonically_increasing_id().alias("gid"), "*"), "vectors")
    askers = asking.join(places.filter("asks"), (F.col("v") == F.col("w")) & F.col("own").eqNullSafe(F.col("by")))
    return places, askers.select("query_id", F.col("gid").alias("asker"))


def search(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", is_query: Column | None = None, k: int = 20,
    curves: int = CURVES, window: float = WINDOW, least_window: int = LEAST_WINDOW, block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows found of largest inner product with each query row.

    is_query: which rows are queries (all, if None); a row is no candidate of its own key. Vectors
    that are null, empty, zero or hold null or non-finite components, vectors of another length than
    most, and rows without a key take no part. Ties go to the smaller key. Of rows that repeat a key,
    the candidate counts once, with its best score, and so does a query that has several vectors. A table
    without vectors gives an empty result; other columns are not looked at, whatever their names.
    """
    asks = F.lit(True) if is_query is None else is_query
    rows = table.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"), asks.alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return table.sparkSession.createDataFrame([], schema)
    dim = sizes[0][0]
    rows = rows.filter(F.size("v") == dim)
    vectors, askers = _distinct(rows, k + 1)
    n = vectors.count()
    reach = max(least_window, int(np.ceil(n * window)))

    def keyed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            raw = _vectors(batch.column(3), dim).astype(np.float64)
            scale = np.abs(raw).max(axis=1, keepdims=True) if len(raw) else raw
            unit = raw / scale
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            for c in range(curves):
                arrays = [pa.array(np.full(len(raw), c, dtype=np.int32)), pa.array(keys_on(unit, c, seed=seed)), *(batch.column(i) for i in range(3))]
                yield pa.RecordBatch.from_arrays(arrays, ["curve", "at", "gid", "low", "asks"])

    def counted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), {}
        for batch in source:
            curve = batch.column(0).to_numpy()
            place = np.zeros(len(curve), dtype=np.int64)
            for c in np.unique(curve).tolist():
                own = curve == c
                place[own] = done.get(c, 0) + np.arange(own.sum())
                done[c] = done.get(c, 0) + int(own.sum())
            arrays = [batch.column(0), pa.array(np.full(len(curve), part, dtype=np.int32)), pa.array(place), batch.column(2), batch.column(4)]
            yield pa.RecordBatch.from_arrays(arrays, ["curve", "part", "place", "gid", "asks"])

    on_curves = mapped(vectors.select("gid", "low", "asks", "v"), keyed, "curve int, at long, gid long, low long, asks boolean")
    parts = max(curves, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = on_curves.repartitionByRange(parts, "curve", "at", "low", "gid").sortWithinPartitions("curve", "at", "low", "gid")
    placed = materialised(mapped(ordered, counted, "curve int, part int, place long, gid long, asks boolean"), "curves")
    # a partition's first row has as many rows before it as the curve's earlier partitions hold
    counts = placed.groupBy("curve", "part").agg(F.count("*").alias("own"))
    counts = counts.withColumn("base", F.sum("own").over(W.partitionBy("curve").orderBy("part")) - F.col("own")).drop("own")
    ranked = placed.join(counts, ["curve", "part"]).withColumn("place", F.col("place") + F.col("base")).select("curve", "place", "gid", "asks")
    stored = ranked.select("curve", F.expr(f"place div {block}").alias("block"), F.lit(False).alias("query"), "place", "gid")
    asked = ranked.filter("asks").select(
        "curve",
        F.explode(F.expr(f"sequence(greatest(place - {reach}, 0L) div {block}, least(place + {reach}, {n - 1}L) div {block})")).alias("block"),
        F.lit(True).alias("query"), "place", "gid",
    )
    met = stored.union(asked).join(vectors.select("gid", "low", "v"), "gid")

    def compared(group: pa.Table) -> pa.Table:
        query = group.column("query").to_numpy()
        place, gids, lows = (group.column(x).to_numpy() for x in ("place", "gid", "low"))
        data = _vectors(group.column("v").combine_chunks(), dim).astype(np.float64)
        q, c = np.flatnonzero(query), np.flatnonzero(~query)
        length = np.sqrt((data * data).sum(axis=1))
        most = float(length[c].max(initial=0.0))
        out: list[list[np.ndarray]] = [[], [], []]
        for low in range(0, len(q) if len(c) else 0, 256):
            part = q[low : low + 256]
            scores = data[part] @ data[c].T
            scores[np.abs(place[part][:, None] - place[c]) > reach] = -np.inf
            for row, i in zip(scores, part, strict=True):
                own = c[_best(row, lows[c], k + 1, 1e-12 * dim * float(length[i]) * most)]
                exact = (data[own] * data[i]).sum(axis=1)
                order = np.lexsort((gids[own], lows[own], -exact))
                _, first = np.unique(lows[own][order], return_index=True)
                kept = order[np.sort(first)[: k + 1]]
                out[0].append(np.full(len(kept), gids[i]))
                out[1].append(gids[own[kept]])
                out[2].append(exact[kept])
        found = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"asker": found[0].astype(np.int64), "gid": found[1].astype(np.int64), "score": found[2].astype(np.float64)})

    near = met.select("curve", "block", "query", "place", "gid", "low", "v").groupBy("curve", "block").applyInArrow(compared, "asker long, gid long, score double")
    best = near.groupBy("asker", "gid").agg(F.max("score").alias("score")).join(vectors.select("gid", "ids"), "gid")
    best = best.select("asker", F.explode("ids").alias("vec_id"), "score").groupBy("asker", "vec_id").agg(F.max("score").alias("score"))
    best = best.withColumn("place", F.row_number().over(W.partitionBy("asker").orderBy(F.desc("score"), "vec_id"))).filter(F.col("place") <= k + 1)
    found = askers.join(best, "asker").filter("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
