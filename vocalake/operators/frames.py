"""Operators over labelled frame series (clip_id, frame, label, value): runs, windows, blocks, overlays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FRAME_S = 0.010


def _order():
    return W.partitionBy("clip_id").orderBy("frame")


def series(events: DataFrame) -> DataFrame:
    """An event table as frame series: one clip per user, frames by time, the type as label."""
    frame = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return events.select(F.col("user_id").alias("clip_id"), frame.cast("long").alias("frame"), F.col("event_type").alias("label"), "value")


def _changed(label: str = "label") -> Column:
    return F.coalesce(F.col(label) != F.lag(label).over(_order()), F.lit(False))


def runs(frames: DataFrame) -> DataFrame:
    """(clip_id, seg_id, start, end, label): maximal runs of a label, half-open, in seconds to three places."""
    marked = frames.withColumn("seg_id", F.sum(_changed().cast("long")).over(_order()))
    spans = marked.groupBy("clip_id", "seg_id", "label").agg(F.min("frame").alias("low"), F.max("frame").alias("high"))
    return spans.select("clip_id", "seg_id", F.round(F.col("low") * FRAME_S, 3).alias("start"), F.round((F.col("high") + 1) * FRAME_S, 3).alias("end"), "label")


def transitions(frames: DataFrame) -> DataFrame:
    """(clip_id, frame, from_label, to_label) where the label differs from the frame before."""
    return frames.select("clip_id", "frame", F.lag("label").over(_order()).alias("from_label"), F.col("label").alias("to_label")).filter("from_label <> to_label")


def dilated(frames: DataFrame, width: int = 5) -> DataFrame:
    """(clip_id, frame, boundary): 1 within width frames of a change."""
    marked = frames.withColumn("changed", _changed().cast("int"))
    return marked.select("clip_id", "frame", F.max("changed").over(_order().rowsBetween(-width, width)).alias("boundary"))


def chunks(frames: DataFrame, size: int = 500) -> DataFrame:
    """(clip_id, chunk, n_frames): consecutive chunks, the last one as long as it is."""
    return frames.groupBy("clip_id", F.expr(f"frame div {size}").alias("chunk")).agg(F.count("*").alias("n_frames"))


def clip_windows(frames: DataFrame, size: int = 400, hop: int = 200) -> DataFrame:
    """(clip_id, start, n_frames, mean_value): full windows only; a clip shorter than one is one window, padded with zeros.

    Each frame goes to the windows that hold it, so that the sums need one shuffle.
    """
    length = F.max("frame").over(W.partitionBy("clip_id")) + 1
    last = F.greatest(F.expr(f"(n - {size}) div {hop}"), F.lit(0))
    rows = frames.withColumn("n", length).withColumn("last", last)
    low = F.greatest(F.expr(f"(frame - {size} + {hop}) div {hop}"), F.lit(0)).cast("long")
    low = F.when(F.col("frame") < size, F.lit(0).cast("long")).otherwise(low)
    high = F.least(F.expr(f"frame div {hop}"), F.col("last"))
    rows = rows.withColumns({"low": low, "high": high}).filter("low <= high")
    rows = rows.select("clip_id", "value", F.explode(F.sequence("low", "high")).alias("k"))
    return rows.groupBy("clip_id", (F.col("k") * hop).alias("start")).agg(F.count("*").alias("n_frames"), (F.sum("value") / size).alias("mean_value"))


def class_weights(frames: DataFrame, classes: list[str]) -> DataFrame:
    """(label, n, weight) of every class: all rows over the number of classes times its rows, 1 for none."""
    found = frames.groupBy("label").agg(F.count("*").alias("n"))
    all_ = frames.sparkSession.createDataFrame([(c,) for c in classes], "label string")
    counted = F.broadcast(all_).join(found, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    total = F.sum("n").over(W.partitionBy())  # a row per class
    return counted.withColumn("weight", total / (len(classes) * F.greatest("n", F.lit(1))))


def overlay(frames: DataFrame, windows: DataFrame, unset: str = "sil") -> DataFrame:
    """(clip_id, frame, label): the label of the surest window over each frame, the earliest of equals, else `unset`.

    windows: (clip_id, first, until, label, conf). Windows are spread over the frames that they hold.
    """
    spread = windows.filter("first < until").select("clip_id", F.explode(F.expr("sequence(first, until - 1)")).alias("frame"), "label", "conf", "first")
    best = spread.groupBy("clip_id", "frame").agg(F.max_by("label", F.struct("conf", -F.col("first"))).alias("found"))
    joined = frames.select("clip_id", "frame").join(best, ["clip_id", "frame"], "left")
    return joined.select("clip_id", "frame", F.coalesce("found", F.lit(unset)).alias("label"))


def judged_windows(frames: DataFrame, size: int = 80, hop: int = 40, least: int = 10, quiet: float = 1.0, sure: float = 0.3) -> DataFrame:
    """(clip_id, first, until, label, conf): windows that are long, loud and sure enough, with their most frequent label.

    conf is that label's share; of equally frequent labels the first by name counts. Windows start
    every `hop` frames, the clip's last ones are cut, and those with less than `least` frames are none.
    """
    length = F.max("frame").over(W.partitionBy("clip_id")) + 1
    rows = frames.withColumn("n", length)
    low = F.when(F.col("frame") < size, F.lit(0).cast("long")).otherwise(F.expr(f"(frame - {size} + {hop}) div {hop}"))
    rows = rows.select("clip_id", "label", "value", "n", F.explode(F.sequence(low, F.expr(f"frame div {hop}"))).alias("k"))
    by_label = rows.groupBy("clip_id", "k", "n", "label").agg(F.count("*").alias("own"), F.sum(F.col("value") * F.col("value")).alias("power"))
    each = by_label.groupBy("clip_id", "k", "n").agg(
        F.sum("own").alias("frames"), F.sum("power").alias("power"), F.max("own").alias("top"), F.min_by("label", F.struct(-F.col("own"), F.col("label"))).alias("label")
    )
    each = each.filter(f"frames >= {least}").withColumn("conf", F.col("top") / F.col("frames"))
    each = each.filter((F.sqrt(F.col("power") / F.col("frames") + 1e-12) >= quiet) & (F.col("conf") >= sure))
    return each.select("clip_id", (F.col("k") * hop).alias("first"), F.least(F.col("k") * hop + size, F.col("n")).alias("until"), "label", "conf")


def first_window(frames: DataFrame, label: str, size: int = 50, hop: int = 10, share: float = 0.4) -> DataFrame:
    """(clip_id, start, share): the first full window in which the label has that share of the frames."""
    length = F.max("frame").over(W.partitionBy("clip_id")) + 1
    rows = frames.withColumn("n", length)
    low = F.when(F.col("frame") < size, F.lit(0).cast("long")).otherwise(F.expr(f"(frame - {size} + {hop}) div {hop}"))
    rows = rows.select("clip_id", "n", (F.col("label") == label).cast("double").alias("hit"), F.explode(F.sequence(low, F.expr(f"frame div {hop}"))).alias("k"))
    each = rows.groupBy("clip_id", (F.col("k") * hop).alias("start"), "n").agg(F.avg("hit").alias("share"))
    each = each.filter(f"start + {size} <= n").filter(F.col("share") >= share)
    return each.groupBy("clip_id").agg(F.min("start").alias("start"), F.min_by("share", "start").alias("share"))


def interpolated(frames: DataFrame, seen: Column) -> DataFrame:
    """(clip_id, frame, value): frames not seen lie on the line between the nearest seen ones; beyond them the value is held."""
    before, after = _order().rowsBetween(W.unboundedPreceding, 0), _order().rowsBetween(0, W.unboundedFollowing)
    known = frames.withColumn("at", F.when(seen, F.struct("frame", "value")))
    known = known.withColumn("l", F.last("at", ignorenulls=True).over(before)).withColumn("r", F.first("at", ignorenulls=True).over(after))
    slope = (F.col("r.value") - F.col("l.value")) / (F.col("r.frame") - F.col("l.frame"))
    value = F.when(F.col("l").isNull(), F.col("r.value")).when(F.col("r").isNull() | (F.col("l.frame") == F.col("r.frame")), F.col("l.value"))
    return known.select("clip_id", "frame", value.otherwise(F.col("l.value") + slope * (F.col("frame") - F.col("l.frame"))).alias("value"))


def block_medians(frames: DataFrame, samples: int = 11025, hop: int = 256, least: float = 0.1) -> DataFrame:
    """(clip_id, block, shift, applied): the exact median of the frames pos // hop .. end // hop of each block of samples.

    A frame on a border belongs to both blocks; a clip has hop samples per frame.
    """
    length = F.max("frame").over(W.partitionBy("clip_id")) + 1
    rows = frames.withColumn("n", length * hop)
    low = F.greatest(F.expr(f"frame * {hop} div {samples} - 1"), F.lit(0))
    high = F.expr(f"least(((frame + 1) * {hop}) div {samples}, (n - 1) div {samples})")
    rows = rows.select("clip_id", "frame", "value", "n", F.explode(F.sequence(low, high)).alias("block"))
    first, end = F.expr(f"block * {samples} div {hop}"), F.expr(f"least((block + 1) * {samples}, n) div {hop}")
    rows = rows.filter((F.col("frame") >= first) & (F.col("frame") < F.greatest(end, first + 1)))
    found = rows.groupBy("clip_id", "block").agg(F.median("value").alias("shift"))
    return found.withColumn("applied", F.abs("shift") > least)


def voiced(frames: DataFrame, share: float = 0.2) -> DataFrame:
    """(clip_id, frame, value): 0 where the value isn't above a share of the clip's exact median."""
    middle = frames.groupBy("clip_id").agg(F.median("value").alias("middle"))
    joined = frames.join(middle, "clip_id")
    return joined.select("clip_id", "frame", F.when(F.col("value") > share * F.col("middle"), F.col("value")).otherwise(0.0).alias("value"))


def painted(spine: DataFrame, spans: DataFrame, unset: str = "sil") -> DataFrame:
    """(clip_id, frame, label): each frame has the label of the last span (by ord) over it, else `unset`.

    spans: (clip_id, ord, first, until, label).
    """
    spread = spans.filter("first < until").select("clip_id", F.explode(F.expr("sequence(first, until - 1)")).alias("frame"), "label", "ord")
    last = spread.groupBy("clip_id", "frame").agg(F.max_by("label", "ord").alias("found"))
    joined = spine.select("clip_id", "frame").join(last, ["clip_id", "frame"], "left")
    return joined.select("clip_id", "frame", F.coalesce("found", F.lit(unset)).alias("label"))


def frame_of(seconds: Column) -> Column:
    """The frame of a time, cut off as double division gives it."""
    return (seconds / F.lit(FRAME_S)).cast("int")


def deltas(frames: DataFrame, width: int = 4) -> DataFrame:
    """(clip_id, frame, delta): the slope of the line through 2 * width + 1 frames, where they all exist."""
    norm = 2 * sum(k * k for k in range(1, width + 1))
    terms = [k * (F.lead("value", k).over(_order()) - F.lag("value", k).over(_order())) for k in range(1, width + 1)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return frames.select("clip_id", "frame", (total / norm).alias("delta")).filter("delta IS NOT NULL")


def padded_deltas(frames: DataFrame, width: int = 4) -> DataFrame:
    """(clip_id, frame, delta, delta2): slope and bend of the line and parabola through 2 * width + 1 frames.

    Near a clip's ends, where frames are missing, the line and parabola are those of its first or last 2 * width + 1
    frames (an interpolating edge); shorter clips give no rows. Weights are a short table.
    """
    size = 2 * width + 1
    x = np.arange(size) - width
    slope = np.linalg.lstsq(np.vander(x, 2, increasing=True), np.eye(size), rcond=None)[0][1]
    bend = 2 * np.linalg.lstsq(np.vander(x, 3, increasing=True), np.eye(size), rcond=None)[0][2]
    weights = [(k, float(slope[k]), float(bend[k])) for k in range(size)]
    table = frames.sparkSession.createDataFrame(weights, "k int, slope double, bend double")
    length = frames.groupBy("clip_id").agg((F.max("frame") + 1).alias("n")).filter(F.col("n") >= size)
    low = F.least(F.greatest(F.col("frame") - width, F.lit(0)), F.col("n") - size)
    asked = frames.join(length, "clip_id").select("clip_id", "frame", F.posexplode(F.sequence(low, low + (size - 1))).alias("k", "of"))
    met = asked.join(frames.select("clip_id", F.col("frame").alias("of"), "value"), ["clip_id", "of"]).join(F.broadcast(table), "k")
    return met.groupBy("clip_id", "frame").agg(F.sum(F.col("value") * F.col("slope")).alias("delta"), F.sum(F.col("value") * F.col("bend")).alias("delta2"))


def rescaled_path(path: DataFrame, lengths: DataFrame, most: int = 5000) -> DataFrame:
    """(clip_id, step, i, j): the steps of a path over series shortened to `most` points, back on the whole series.

    lengths: (clip_id, n, m). Both indices are scaled if either series is longer, and rounded half to even.
    """
    long = F.greatest("n", "m") > most
    back = lambda at, size: F.when(long, F.bround(F.col(at) * (F.col(size) / F.lit(float(most))))).otherwise(F.col(at)).cast("long")
    return path.join(lengths, "clip_id").select("clip_id", "step", back("i", "n").alias("i"), back("j", "m").alias("j"))


def resampled(frames: DataFrame, most: int = 50) -> DataFrame:
    """(clip_id, k, value): clips longer than `most` frames on `most` evenly spaced points, by linear interpolation; others as they are."""
    length = frames.groupBy("clip_id").agg((F.max("frame") + 1).alias("n"))
    points = length.select("clip_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", F.lit(most)) - 1)).alias("k"))
    place = F.when(F.col("n") > most, F.col("k") * (F.col("n") - 1) / F.lit(float(most - 1))).otherwise(F.col("k").cast("double"))
    points = points.withColumn("x", place).withColumn("low", F.floor("x").cast("long")).withColumn("high", F.least(F.col("low") + 1, F.col("n") - 1))
    own = frames.select("clip_id", F.col("frame").alias("at"), F.col("value").alias("v"))
    points = points.join(own.withColumnsRenamed({"at": "low", "v": "a"}), ["clip_id", "low"]).join(own.withColumnsRenamed({"at": "high", "v": "b"}), ["clip_id", "high"])
    return points.select("clip_id", "k", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("x") - F.col("low"))).alias("value"))
