"""Signal operators over samples, frames and vectors as rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vocalake.functions.vectors import normalised
from vocalake.operators.kernels import cepstral_distance, constant_q_features, linear_features, mel_features, pitch_track, triangles, waveform

_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def peak_normalised(frames: DataFrame, level: float = -3.0) -> DataFrame:
    """(clip_id, frame, value) scaled so that the clip's peak is at the level in decibels of full scale."""
    peak = frames.groupBy("clip_id").agg(F.max(F.abs("value")).alias("peak"))
    return frames.join(peak, "clip_id").select("clip_id", "frame", (F.col("value") * 10 ** (level / 20) / (F.col("peak") + 1e-9)).alias("value"))


def limited(frames: DataFrame, above: float = 0.99, to: float = 0.95) -> DataFrame:
    """(clip_id, frame, value): clips whose peak is above `above` are scaled to a peak of `to`."""
    peak = frames.groupBy("clip_id").agg((F.max(F.abs("value")) + 1e-9).alias("peak"))
    scaled = F.when(F.col("peak") > above, F.col("value") / F.col("peak") * to).otherwise(F.col("value"))
    return frames.join(peak, "clip_id").select("clip_id", "frame", scaled.alias("value"))


def energetic(frames: DataFrame, decibels: float = -35.0) -> DataFrame:
    """Frames whose level over the clip's largest value is above the bound."""
    top = frames.groupBy("clip_id").agg(F.max("value").alias("top"))
    level = 20 * F.log10(F.col("value") / (F.col("top") + 1e-12) + 1e-12)
    return frames.join(top, "clip_id").filter(level > decibels).drop("top")


def clipped(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def semitones(reference: Column, source: Column, least: float = 50.0, most: float = 6.0) -> Column:
    """12 log2 of the ratio where both are above `least`, within +-most; else 0."""
    ratio = 12.0 * F.log2(reference / source)
    return F.when((reference > least) & (source > least), clipped(ratio, -most, most)).otherwise(0.0)


def blended(first: DataFrame, second: DataFrame, weight: float = 0.85) -> DataFrame:
    """(clip_id, frame, value): weight * first + (1 - weight) * second on the frames that both have."""
    other = second.select("clip_id", "frame", F.col("value").alias("b"))
    return first.join(other, ["clip_id", "frame"]).select("clip_id", "frame", (weight * F.col("value") + (1 - weight) * F.col("b")).alias("value"))


def joined_chunks(first: DataFrame, second: DataFrame, overlap: int) -> DataFrame:
    """(clip_id, frame, value): the second chunk begins `overlap` frames before the first ends, with linear weights there."""
    n = first.groupBy("clip_id").agg((F.max("frame") + 1).alias("n"))
    moved = second.join(n, "clip_id").withColumn("frame", F.col("frame") + F.col("n") - overlap)
    into = F.least(F.greatest((F.col("frame") - F.col("n") + overlap + 0.5) / overlap, F.lit(0.0)), F.lit(1.0))
    parts = first.join(n, "clip_id").withColumn("part", F.col("value") * (1 - into)).unionByName(moved.withColumn("part", F.col("value") * into))
    return parts.groupBy("clip_id", "frame").agg(F.sum("part").alias("value"))


def snr(clean: Column, noise: Column) -> Column:
    """Decibels between mean powers, as an aggregate."""
    return 10 * F.log10((F.avg(clean * clean) + 1e-12) / (F.avg(noise * noise) + 1e-12))


def snr_sweep(frames: DataFrame, epsilons: list[float]) -> DataFrame:
    """(clip_id, epsilon, snr_db, flipped): each clip's z-normed values with a step of epsilon against their sign.

    flipped is the share of frames whose sign changes. The grid is a short list and joined by broadcast.
    A value at its clip's mean has a sign that hangs on the sum's last bit, so sums go by frame, whatever the splits of the input.
    """
    clip = W.partitionBy("clip_id").orderBy("frame").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    z = frames.select("clip_id", ((F.col("value") - F.avg("value").over(clip)) / (F.stddev_pop("value").over(clip) + 1e-6)).alias("x"))
    grid = frames.sparkSession.createDataFrame([(e,) for e in epsilons], "epsilon double")
    rows = z.crossJoin(F.broadcast(grid)).withColumn("noise", -F.col("epsilon") * F.signum("x"))
    return rows.groupBy("clip_id", "epsilon").agg(
        snr(F.col("x"), F.col("noise")).alias("snr_db"), F.avg((F.signum(F.col("x") + F.col("noise")) != F.signum("x")).cast("double")).alias("flipped")
    )


def components(table: DataFrame, key: str, vector: str, *keep: str) -> DataFrame:
    """(key, keep..., dim, x): a row per component."""
    return table.select(key, *keep, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def z_normed(table: DataFrame, key: str, vector: str, eps: float = 1e-6) -> DataFrame:
    """(key, dim, z): each component over the whole table's mean and deviation of its place."""
    rows = components(table, key, vector)
    stats = rows.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    return rows.join(F.broadcast(stats), "dim").select(key, "dim", ((F.col("x") - F.col("mean")) / (F.col("sd") + eps)).alias("z"))


def pooled(table: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, pooled): means and deviations of each component, one behind the other, at length 1."""
    rows = table.select(group, F.posexplode(vector).alias("dim", "x"))
    stats = rows.groupBy(group, "dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    both = stats.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))).alias("all"))
    return both.select(group, normalised(F.concat(F.col("all.m"), F.col("all.s"))).alias("pooled"))


def matched_statistics(source: DataFrame, target: DataFrame, alpha: float = 0.85, eps: float = 1e-6) -> DataFrame:
    """(id, dim, y): source's components (id, dim, x) moved to target's mean and deviation, blended with what they were."""

    def stats(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("dim").agg(F.avg("x").alias(f"m{tag}"), (F.stddev_pop("x") + eps).alias(f"s{tag}"))

    both = stats(source, "s").join(stats(target, "t"), "dim")
    moved = (F.col("x") - F.col("ms")) / F.col("ss") * F.col("st") + F.col("mt")
    return source.join(F.broadcast(both), "dim").select("id", "dim", (alpha * moved + (1 - alpha) * F.col("x")).alias("y"))


def filterbank(spark: SparkSession, filters: int = 8, size: int = 126, rate: int = 16000) -> DataFrame:
    """(filter, bin, weight): the non-zero weights of linear triangular filters."""
    weights = triangles(filters, size, rate)
    rows = [(int(k), int(b), float(weights[k, b])) for k, b in zip(*np.nonzero(weights), strict=True)]
    return spark.createDataFrame(rows, "filter int, bin int, weight double")


def filtered(rows: DataFrame, bank: DataFrame, key: str) -> DataFrame:
    """(key, filter, energy): rows (key, dim, x) through a filter bank, as a join and a sum."""
    met = rows.join(F.broadcast(bank), rows["dim"] == bank["bin"])
    return met.groupBy(key, "filter").agg(F.sum(F.col("x") * F.col("x") * F.col("weight")).alias("energy"))


def spectral_subtraction(rows: DataFrame, clip: str, frame: str, noise_frames: int, alpha: float = 2.0, beta: float = 0.02) -> DataFrame:
    """(clip, frame, dim, clean): magnitudes less alpha times the noise profile of the first frames, beta of them at least."""
    profile = rows.filter(F.col(frame) < noise_frames).groupBy(clip, "dim").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("noise"))
    joined = rows.join(profile, [clip, "dim"], "left")
    return joined.select(clip, frame, "dim", F.greatest(F.col("x") - alpha * F.coalesce("noise", F.lit(0.0)), beta * F.col("x")).alias("clean"))


#: Numbers of the pairs that are sent to a worker at once, about; a longer pair goes alone.
PAIR_NUMBERS = 1 << 18


def cepstral_distances(pairs: DataFrame, key: str) -> DataFrame:
    """(key, mcd) of rows (key, a, b), a and b being arrays of coefficient arrays.

    A record batch holds so many pairs, whatever their length, as packed numbers.
    """

    def matrix(cell: pa.ListScalar) -> np.ndarray:
        frames = cell.values
        return np.asarray(frames.flatten(), dtype=np.float64).reshape(len(frames), -1) if len(frames) else np.zeros((0, 1))

    def work(batches):
        for batch in batches:
            found = [cepstral_distance(matrix(a), matrix(b)) for a, b in zip(batch["a"], batch["b"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(found, pa.float64())], [key, "mcd"])

    conf = pairs.sparkSession.conf
    if conf.get(_BATCH_LIMIT, None) is None:
        conf.set(_BATCH_LIMIT, str(8 * PAIR_NUMBERS))
    return pairs.select(key, "a", "b").mapInArrow(work, f"{key} {pairs.schema[key].dataType.simpleString()}, mcd double")


def features(clips: DataFrame, kind: str = "mel", key: str = "path") -> DataFrame:
    """(key, frame, dim, x): features of each clip (key, rate, samples array<float>): `mel` (119), `linear` or `constant_q` (60). Clips of under 9 frames have none."""
    make, hop = {"mel": (mel_features, 160), "linear": (linear_features, 160), "constant_q": (constant_q_features, 256)}[kind]

    def work(batches):
        for pdf in batches:
            for name, rate, samples in zip(pdf[key], pdf["rate"], pdf["samples"], strict=True):
                if len(samples) >= 8 * hop:
                    found = make(np.asarray(samples, dtype=np.float64), int(rate))
                    frame, dim = (k.ravel() for k in np.indices(found.shape))
                    yield pd.DataFrame({key: [name] * found.size, "frame": frame, "dim": dim, "x": found.ravel()})

    return clips.select(key, "rate", "samples").mapInPandas(work, f"{key} {clips.schema[key].dataType.simpleString()}, frame int, dim int, x double")


def pitches(clips: DataFrame, key: str = "path") -> DataFrame:
    """(key, frame, hertz, level) of each clip (key, rate, samples array<float>); hertz is 0 in quiet frames. An empty clip has none."""

    def work(batches):
        for pdf in batches:
            for name, rate, samples in zip(pdf[key], pdf["rate"], pdf["samples"], strict=True):
                if len(samples):
                    hertz, level = pitch_track(np.asarray(samples, dtype=np.float64), int(rate))
                    yield pd.DataFrame({key: [name] * len(hertz), "frame": np.arange(len(hertz)), "hertz": hertz, "level": level})

    return clips.select(key, "rate", "samples").mapInPandas(work, f"{key} {clips.schema[key].dataType.simpleString()}, frame int, hertz double, level double")


def waveforms(spectra: DataFrame, key: str = "path") -> DataFrame:
    """(key, rate, samples array<float>) near each mel power spectrum (key, rate, power array<array<double>>, a row per frame)."""

    def work(batches):
        for pdf in batches:
            made = [waveform(np.array([list(f) for f in p]), int(r)) for p, r in zip(pdf["power"], pdf["rate"], strict=True)]
            yield pd.DataFrame({key: pdf[key], "rate": pdf["rate"], "samples": made})

    return spectra.select(key, "rate", "power").mapInPandas(work, f"{key} {spectra.schema[key].dataType.simpleString()}, rate int, samples array<float>")


def mean_power(value: Column) -> Column:
    """The root of the mean square, as an aggregate."""
    return F.sqrt(F.avg(value * value) + 1e-12)


def leading(frames: DataFrame, n: int) -> DataFrame:
    """The first n frames of each clip."""
    return frames.filter(F.col("frame") < n)


def centred(frames: DataFrame) -> DataFrame:
    """(clip_id, frame, value) less the clip's mean."""
    return frames.select("clip_id", "frame", (F.col("value") - F.avg("value").over(W.partitionBy("clip_id"))).alias("value"))
