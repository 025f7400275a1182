"""Joins by intervals and by distance, as equi-joins on time buckets with a residual condition."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlapping(words: DataFrame, spans: DataFrame, by: str, least: float = 0.05, bucket: float = 1.0) -> DataFrame:
    """Pairs of a word (by, w_id, w_start, w_end) and a span (by, s_id, s_start, s_end) that share more than `least` seconds.

    Both sides are put into the time buckets that they touch, and a pair counts in the bucket in which
    its common part begins, so that nothing is compared across the whole of a group or found twice.
    """

    def dealt(df: DataFrame, start: str, end: str) -> DataFrame:
        return df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))

    pairs = dealt(words, "w_start", "w_end").join(dealt(spans, "s_start", "s_end"), [by, "bucket"])
    low = F.greatest("w_start", "s_start")
    shared = F.greatest(F.lit(0.0), F.least("w_end", "s_end") - low)
    return pairs.withColumn("overlap", shared).filter((F.col("overlap") > least) & (F.floor(low / bucket) == F.col("bucket"))).drop("bucket")


def near(left: DataFrame, right: DataFrame, by: str, at: str, other: str, tolerance: int) -> DataFrame:
    """Pairs with |left.at - right.other| <= tolerance: the right side is dealt to its bucket and the two beside it."""
    size = 2 * tolerance + 1
    dealt = right.withColumn("bucket", F.explode(F.array(*[F.floor(F.col(other) / size) + k for k in (-1, 0, 1)])))
    pairs = left.withColumn("bucket", F.floor(F.col(at) / size)).join(dealt, [by, "bucket"])
    return pairs.filter(F.abs(F.col(at) - F.col(other)) <= tolerance).drop("bucket")


def hit_rate(gold: DataFrame, pred: DataFrame, by: str, tolerance: int = 20) -> DataFrame:
    """(n_gold, hits, hit_rate) over all groups: gold frames with a prediction within the tolerance; 1 without gold.

    gold (by, g), pred (by, p). A prediction may serve several gold frames.
    """
    hit = near(gold.distinct(), pred.distinct(), by, "g", "p", tolerance).select(by, "g").distinct().withColumn("hit", F.lit(1))
    joined = gold.join(hit, [by, "g"], "left")
    sums = joined.agg(F.count("*").alias("n_gold"), F.count("hit").alias("hits"))
    return sums.withColumn("hit_rate", F.when(F.col("n_gold") == 0, 1.0).otherwise(F.col("hits") / F.col("n_gold")))


def greedy_matches(pred: DataFrame, gold: DataFrame, by: str, tolerance: int = 20) -> DataFrame:
    """(by, p, p_kind, g, g_kind): predictions in time order take the nearest gold frame that is free, the earliest of equals.

    The order of the predictions matters, so that each group's pairs within the tolerance are walked
    through in Python; the pairs come from the bucket join.
    """
    pairs = near(pred, gold, by, "p", "g", tolerance).select(by, "p", "p_kind", "g", "g_kind")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(far=(group["g"] - group["p"]).abs()).sort_values(["p", "far", "g"], kind="stable")
        used, done, keep = set(), set(), []
        for k, p, g in zip(group.index, group["p"], group["g"], strict=True):
            if p not in done and g not in used:
                used.add(g)
                done.add(p)
                keep.append(k)
        return group.loc[keep, [by, "p", "p_kind", "g", "g_kind"]]

    return pairs.groupBy(by).applyInPandas(walk, pairs.schema)


def looked_up(tokens: DataFrame, table: DataFrame, token: str, term: str) -> DataFrame:
    """tokens with the gloss of the equal lower-case term, null where there is none."""
    return tokens.join(table, F.lower(tokens[token]) == table[term], "left").drop(term)


def cache_split(asked: DataFrame, cache: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(hits with their cached value, misses once each)."""
    return asked.join(cache.select(key, value), key), asked.select(key).distinct().join(cache, key, "left_anti")


def zipped(first: DataFrame, second: DataFrame, by: str | list[str], a: str, b: str) -> DataFrame:
    """(by, pos, a, b): candidates of two lists by their place; what the shorter list lacks is cut off."""
    keys = [by] if isinstance(by, str) else by
    left = first.select(*keys, F.posexplode(a).alias("pos", a))
    return left.join(second.select(*keys, F.posexplode(b).alias("pos", b)), [*keys, "pos"])


def gathered(path: DataFrame, target: DataFrame, by: str) -> DataFrame:
    """(by, j, value): out[j] = target[i] along a warp path (by, step, i, j), the last step of a j wins."""
    joined = path.join(target.select(by, F.col("frame").alias("i"), "value"), [by, "i"])
    return joined.groupBy(by, "j").agg(F.max_by("value", "step").alias("value"))


def batches(rows: Iterator, size: int) -> Iterator[list]:
    """Lists of `size` rows, the last one as long as it is."""
    out: list = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out
