"""Seeded splits, balanced samples and batches, as functions of hashes of the rows."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_order(*keys: str, seed: int = 0) -> Column:
    """A number that orders rows pseudorandomly: md5 of the seed and the keys, which other engines have as well."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def grouped_split(rows: DataFrame, group: str, share: float = 0.7, seed: int = 0) -> DataFrame:
    """rows with `part`, train or test: whole groups go to one part, by the first 8 hex digits of their hash."""
    place = F.conv(F.substring(hash_order(group, seed=seed), 1, 8), 16, 10).cast("long")
    return rows.withColumn("part", F.when(place < int(share * 2**32), "train").otherwise("test"))


def balanced(rows: DataFrame, label: str, key: str, seed: int = 0, digits: int = 4) -> DataFrame:
    """As many rows of each label as the rarest has, the first in hash order.

    Rows are counted by label and the first digits of their hash; running sums over these few counts tell which
    rows stay and which go, and only those of the bin in which a label's border falls are ranked.
    """
    whole = hash_order(key, seed=seed)
    placed = rows.withColumns({"__hash": whole, "__bin": F.substring(whole, 1, digits)})
    bins = placed.groupBy(label, "__bin").agg(F.count("*").alias("__own"))
    least = bins.groupBy(label).agg(F.sum("__own").alias("n")).agg(F.min("n").alias("__least"))
    before = F.sum("__own").over(W.partitionBy(label).orderBy("__bin")) - F.col("__own")
    bins = bins.withColumn("__before", before).crossJoin(F.broadcast(least)).filter("__before < __least")
    kept = placed.join(bins, [label, "__bin"])
    inside = kept.filter("__before + __own <= __least")
    order = W.partitionBy(label, "__bin").orderBy("__hash", key)
    border = kept.filter("__before + __own > __least").withColumn("__rank", F.row_number().over(order)).filter("__before + __rank <= __least")
    return inside.select(rows.columns).unionByName(border.select(rows.columns))


def batch_numbers(rows: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """rows with `batch`: `size` rows of a group at a time in the order given."""
    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(group).orderBy(order)) - 1) / size).cast("long"))


def interleaved(chunks: DataFrame, seed: int = 0, stay: float = 0.2, gap: int = 25, unset: str = "sil") -> DataFrame:
    """(set, frame, label): the chunks (set, kind, ord, n_frames, label) of two kinds, one behind the other with gaps, as frame labels.

    A set begins with the first kind by name and changes the kind behind a chunk, but for a share `stay` of them, by a hash of the
    seed; where a kind has no chunk left the other goes on. Chunks keep their order within a kind. Every chunk is followed by
    `gap` frames of `unset`. The order is a function of the set's chunks, so that reruns agree; a set is one task's work
    in it, its frames are spread after it.
    """

    def order(group: pd.DataFrame) -> pd.DataFrame:
        kinds = sorted(group["kind"].unique())
        left = {k: group[group["kind"] == k].sort_values("ord").index.tolist() for k in kinds}
        out, now = [], 0
        while any(left.values()):
            if left[kinds[now]]:
                out.append(left[kinds[now]].pop(0))
                draw = int(hashlib.md5(f"{seed}:{group['set'].iloc[0]}:{len(out)}".encode()).hexdigest()[:8], 16) / 2**32
                now = now if draw < stay else (now + 1) % len(kinds)
            else:
                now = (now + 1) % len(kinds)
        found = group.loc[out, ["set", "label", "n_frames"]]
        return found.assign(first=(found["n_frames"] + gap).cumsum() - found["n_frames"] - gap)

    kind = chunks.schema["set"].dataType.simpleString()
    placed = chunks.groupBy("set").applyInPandas(order, f"set {kind}, label string, n_frames long, first long")
    frames = placed.select("set", "label", "n_frames", "first", F.explode(F.expr(f"sequence(first, first + n_frames + {gap} - 1)")).alias("frame"))
    return frames.select("set", "frame", F.when(F.col("frame") < F.col("first") + F.col("n_frames"), F.col("label")).otherwise(unset).alias("label"))


def longest_first(terms: DataFrame, term: str, most: int) -> DataFrame:
    """The `most` longest terms, ties in their own order."""
    return terms.orderBy(F.desc(F.length(term)), term).limit(most)
