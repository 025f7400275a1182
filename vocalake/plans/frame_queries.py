"""Frame queries: events as labelled frame series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalake.operators import frames as fr
from vocalake.operators import evaluation as ev
from vocalake.operators import joins, sampling, signal
from vocalake.sources.tables import table

#: The event types, as the classes of the label series.
CLASSES = ["click", "error", "purchase", "signup", "view"]


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.series(table(spark, sf_dir, "events"))


def rle(spark, sf_dir):
    return fr.runs(series(spark, sf_dir))


def transitions(spark, sf_dir):
    return fr.transitions(series(spark, sf_dir))


def dilate(spark, sf_dir):
    return fr.dilated(series(spark, sf_dir))


def chunks(spark, sf_dir):
    return fr.chunks(series(spark, sf_dir), 50)


def class_weights(spark, sf_dir):
    return fr.class_weights(series(spark, sf_dir), [*CLASSES, "none"]).withColumn("weight", F.round("weight", 8))


def windows(spark, sf_dir):
    return fr.judged_windows(series(spark, sf_dir), 16, 8, 2).withColumn("conf", F.round("conf", 8))


def overlay(spark, sf_dir):
    own = series(spark, sf_dir)
    return fr.overlay(own, fr.judged_windows(own, 16, 8, 2))


def sliding(spark, sf_dir):
    return fr.clip_windows(series(spark, sf_dir), 40, 20).withColumn("mean_value", F.round("mean_value", 6))


def interpolated(spark, sf_dir):
    return fr.interpolated(series(spark, sf_dir), F.col("label") == "view").withColumn("value", F.round("value", 6))


def block_median(spark, sf_dir):
    return fr.block_medians(series(spark, sf_dir), 2500).withColumn("shift", F.round("shift", 6))


def voiced(spark, sf_dir):
    return fr.voiced(series(spark, sf_dir))


def first_window(spark, sf_dir):
    return fr.first_window(series(spark, sf_dir), "view", 20, 5, 0.3).withColumn("share", F.round("share", 8))


def painted(spark, sf_dir):
    own = series(spark, sf_dir)
    spans = own.select("clip_id", F.col("frame").alias("ord"), F.col("frame").alias("first"), (F.col("frame") + (F.floor("value") % 7)).alias("until"), "label")
    return fr.painted(own, spans)


def deltas(spark, sf_dir):
    return fr.deltas(series(spark, sf_dir)).withColumn("delta", F.round("delta", 6))


def padded_deltas(spark, sf_dir):
    out = fr.padded_deltas(series(spark, sf_dir))
    return out.select("clip_id", "frame", (F.round("delta", 6) + 0.0).alias("delta"), (F.round("delta2", 6) + 0.0).alias("delta2"))


def rescaled_path(spark, sf_dir):
    """Each user's path i -> i // 2 over series shortened to 20 points, back on series of n and of n // 2 + 1 frames."""
    own = series(spark, sf_dir).groupBy("clip_id").agg((F.max("frame") + 1).alias("n"))
    path = own.select("clip_id", F.explode(F.expr("sequence(0L, 19L)")).alias("step")).select("clip_id", "step", F.col("step").alias("i"), F.expr("step div 2").alias("j"))
    return fr.rescaled_path(path, own.select("clip_id", "n", F.expr("n div 2 + 1").alias("m")), 20)


def frame_index(spark, sf_dir):
    return series(spark, sf_dir).select("clip_id", "frame", fr.frame_of(F.col("value")).alias("at"))


def cross_fade(spark, sf_dir):
    """Each user's series behind that of the user before, with five frames of both."""
    own = series(spark, sf_dir).select("clip_id", "frame", "value")
    after = own.withColumn("clip_id", F.col("clip_id") - 1)
    return signal.joined_chunks(own, after, 5).withColumn("value", F.round("value", 6))


def mean_power(spark, sf_dir):
    return series(spark, sf_dir).groupBy("clip_id").agg(F.round(signal.mean_power(F.col("value")), 6).alias("rms"))


def head_slice(spark, sf_dir):
    """The first 20 frames of each clip, less their mean: the slice is the operator."""
    return signal.centred(signal.leading(series(spark, sf_dir), 20)).withColumn("value", F.round("value", 6))


def counts_report(spark, sf_dir):
    return ev.counts_report(series(spark, sf_dir), "label", CLASSES)


def synthetic_set(spark, sf_dir):
    """Runs of views and of anything else of each user, interleaved anew with gaps as a labelled set."""
    runs = fr.runs(series(spark, sf_dir).withColumn("label", F.when(F.col("label") == "view", "view").otherwise("other")))
    chunks = runs.select(F.col("clip_id").alias("set"), F.col("label").alias("kind"), F.col("seg_id").alias("ord"), F.round((F.col("end") - F.col("start")) * 100).cast("long").alias("n_frames"), "label")
    return sampling.interleaved(chunks, 3, 0.2, 2)


def resampled(spark, sf_dir):
    return fr.resampled(series(spark, sf_dir), 25).withColumn("value", F.round("value", 6))


def boundary_hits(spark, sf_dir):
    """Changes of the series against changes of the same series with the label view held over."""
    gold = fr.transitions(series(spark, sf_dir)).select("clip_id", F.col("frame").alias("g"))
    pred = fr.transitions(series(spark, sf_dir)).filter("to_label = 'view'").select("clip_id", (F.col("frame") + 2).alias("p"))
    return joins.hit_rate(gold, pred, "clip_id", 1).withColumn("hit_rate", F.round("hit_rate", 8))


def overlap_join(spark, sf_dir):
    """Event words of value hundredths of a second against all runs of views and of anything else."""
    own = series(spark, sf_dir)
    words = own.select("clip_id", F.col("frame").alias("w_id"), (F.col("frame") * 0.01).alias("w_start"), (F.col("frame") * 0.01 + F.least("value", F.lit(50.0)) / 100).alias("w_end"))
    spans = fr.runs(own.withColumn("label", (F.col("label") == "view").cast("string")))
    spans = spans.select("clip_id", F.col("seg_id").alias("s_id"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    return joins.overlapping(words, spans, "clip_id", 0.05, 0.25).select("clip_id", "w_id", "s_id", F.round("overlap", 6).alias("overlap"))


def peak_norm(spark, sf_dir):
    return signal.limited(signal.peak_normalised(series(spark, sf_dir)), 0.5, 0.4).withColumn("value", F.round("value", 8))


def energy_mask(spark, sf_dir):
    return signal.energetic(series(spark, sf_dir), -20.0).select("clip_id", "frame", "value")


def blend(spark, sf_dir):
    """Each user's series with that of the next user, as far as both go."""
    own = series(spark, sf_dir)
    other = own.withColumn("clip_id", F.col("clip_id") - 1)
    return signal.blended(own, other).withColumn("value", F.round("value", 6))


def snr_sweep(spark, sf_dir):
    out = signal.snr_sweep(series(spark, sf_dir), [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0])
    return out.select("clip_id", "epsilon", (F.round("snr_db", 5) + 0.0).alias("snr_db"), F.round("flipped", 8).alias("flipped"))


def semitones(spark, sf_dir):
    own = series(spark, sf_dir)
    return own.select("clip_id", "frame", F.round(signal.semitones(F.col("value") * 4, F.lit(110.0)), 6).alias("semitones"))


F_SQL = "f AS (SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_type AS label, value FROM events)"
_P = "OVER (PARTITION BY clip_id ORDER BY frame)"
_CH = f"ch AS (SELECT *, coalesce((label <> lag(label) {_P})::INT, 0) AS changed FROM f)"
_RUNS = f"""{_CH},
rn AS (SELECT *, sum(changed) {_P} AS seg_id FROM ch),
runs AS (SELECT clip_id, seg_id::BIGINT AS seg_id, round(min(frame) * 0.01::DOUBLE, 3) AS "start", round((max(frame) + 1) * 0.01::DOUBLE, 3) AS "end", label
         FROM rn GROUP BY clip_id, seg_id, label)"""
_TR = f"tr AS (SELECT * FROM (SELECT clip_id, frame, lag(label) {_P} AS from_label, label AS to_label FROM f) WHERE from_label <> to_label)"
_N = "fn AS (SELECT *, max(frame) OVER (PARTITION BY clip_id) + 1 AS n FROM f)"


def _windows_sql(size: int, hop: int, least: int) -> str:
    return f"""{_N},
wk AS (SELECT clip_id, n, unnest(range(0, (n - 1) // {hop} + 1)) AS k FROM (SELECT DISTINCT clip_id, n FROM fn)),
wl AS (SELECT w.clip_id, k, n, label, count(*) AS own, sum(value * value) AS power
       FROM wk w JOIN f ON f.clip_id = w.clip_id AND f.frame >= k * {hop} AND f.frame < k * {hop} + {size} GROUP BY ALL),
wr AS (SELECT *, row_number() OVER (PARTITION BY clip_id, k ORDER BY own DESC, label) AS rk,
         sum(own) OVER (PARTITION BY clip_id, k) AS frames, sum(power) OVER (PARTITION BY clip_id, k) AS total FROM wl),
win AS (SELECT clip_id, k * {hop} AS first, least(k * {hop} + {size}, n) AS until, label, (own / frames)::DOUBLE AS conf
        FROM wr WHERE rk = 1 AND frames >= {least} AND sqrt(total / frames + 1e-12) >= 1.0 AND own / frames >= 0.3)"""


def _padded_weights() -> str:
    """(neighbour, slope, bend) of the line and parabola through nine frames, by their normal equations."""
    return ", ".join(f"({x + 4}, {x} / 60.0::DOUBLE, 2 * ({x * x} - 60 / 9.0::DOUBLE) / 308.0::DOUBLE)" for x in range(-4, 5))


QUERIES = {
    "frame_rle_segments": rle,
    "frame_transitions": transitions,
    "frame_boundary_dilate": dilate,
    "frame_chunks": chunks,
    "frame_class_weights": class_weights,
    "frame_judged_windows": windows,
    "frame_weak_label_overlay": overlay,
    "frame_sliding_clips": sliding,
    "frame_interp_fill": interpolated,
    "frame_block_median": block_median,
    "frame_voicing_mask": voiced,
    "frame_first_window": first_window,
    "frame_paint": painted,
    "frame_deltas": deltas,
    "frame_resample": resampled,
    "frame_padded_deltas": padded_deltas,
    "frame_rescaled_path": rescaled_path,
    "frame_index": frame_index,
    "frame_counts_report": counts_report,
    "sample_synthetic_set": synthetic_set,
    "sig_cross_fade": cross_fade,
    "sig_mean_power": mean_power,
    "sig_head_slice": head_slice,
    "eval_boundary_hits": boundary_hits,
    "eval_overlap_join": overlap_join,
    "sig_peak_norm": peak_norm,
    "sig_energy_mask": energy_mask,
    "sig_blend": blend,
    "sig_snr_sweep": snr_sweep,
    "sig_semitones": semitones,
}
SQL = {
    "frame_rle_segments": f'WITH {F_SQL}, {_RUNS} SELECT clip_id, seg_id, "start", "end", label FROM runs',
    "frame_transitions": f"WITH {F_SQL}, {_TR} SELECT * FROM tr",
    "frame_boundary_dilate": f"WITH {F_SQL}, {_CH} SELECT clip_id, frame, max(changed) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS boundary FROM ch",
    "frame_chunks": f"WITH {F_SQL} SELECT clip_id, frame // 50 AS chunk, count(*) AS n_frames FROM f GROUP BY ALL",
    "frame_class_weights": f"""WITH {F_SQL},
c AS (SELECT col0 AS label FROM (VALUES {', '.join(f"('{c}')" for c in [*CLASSES, 'none'])})),
n AS (SELECT c.label, count(f.label) AS n FROM c LEFT JOIN f ON f.label = c.label GROUP BY c.label)
SELECT label, n, round((sum(n) OVER ()) / (6 * greatest(n, 1)), 8)::DOUBLE AS weight FROM n""",
    "frame_judged_windows": f"WITH {F_SQL}, {_windows_sql(16, 8, 2)} SELECT clip_id, first, until, label, round(conf, 8) AS conf FROM win",
    "frame_weak_label_overlay": f"""WITH {F_SQL}, {_windows_sql(16, 8, 2)},
b AS (SELECT f.clip_id, f.frame, win.label, row_number() OVER (PARTITION BY f.clip_id, f.frame ORDER BY conf DESC, first) AS rk
      FROM f JOIN win ON win.clip_id = f.clip_id AND f.frame >= first AND f.frame < until)
SELECT f.clip_id, f.frame, coalesce(b.label, 'sil') AS label FROM f LEFT JOIN b ON b.clip_id = f.clip_id AND b.frame = f.frame AND rk = 1""",
    "frame_sliding_clips": f"""WITH {F_SQL}, {_N},
w AS (SELECT clip_id, unnest(range(0, greatest((n - 40) // 20, 0) + 1)) * 20 AS "start" FROM (SELECT DISTINCT clip_id, n FROM fn))
SELECT w.clip_id, "start", count(*) AS n_frames, round(sum(value) / 40, 6) AS mean_value
FROM w JOIN f ON f.clip_id = w.clip_id AND f.frame >= "start" AND f.frame < "start" + 40 GROUP BY ALL""",
    "frame_interp_fill": f"""WITH {F_SQL},
k AS (SELECT *, CASE WHEN label = 'view' THEN frame END AS kf, CASE WHEN label = 'view' THEN value END AS kv FROM f),
b AS (SELECT *, last_value(kf IGNORE NULLS) OVER a AS lf, last_value(kv IGNORE NULLS) OVER a AS lv, first_value(kf IGNORE NULLS) OVER z AS rf, first_value(kv IGNORE NULLS) OVER z AS rv
      FROM k WINDOW a AS (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    z AS (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT clip_id, frame, round(CASE WHEN lf IS NULL THEN rv WHEN rf IS NULL OR lf = rf THEN lv ELSE lv + (rv - lv) / (rf - lf) * (frame - lf) END, 6) AS value FROM b""",
    "frame_block_median": f"""WITH {F_SQL}, {_N},
b AS (SELECT clip_id, n * 256 AS len, unnest(range(0, (n * 256 - 1) // 2500 + 1)) AS block FROM (SELECT DISTINCT clip_id, n FROM fn)),
r AS (SELECT *, block * 2500 // 256 AS lo, greatest(least((block + 1) * 2500, len) // 256, block * 2500 // 256 + 1) AS hi FROM b),
m AS (SELECT r.clip_id, block, median(value) AS shift FROM r JOIN f ON f.clip_id = r.clip_id AND f.frame >= lo AND f.frame < hi GROUP BY ALL)
SELECT clip_id, block, round(shift, 6) AS shift, abs(shift) > 0.1 AS applied FROM m""",
    "frame_voicing_mask": f"WITH {F_SQL}, m AS (SELECT *, median(value) OVER (PARTITION BY clip_id) AS md FROM f) SELECT clip_id, frame, CASE WHEN value > 0.2::DOUBLE * md THEN value ELSE 0.0 END AS value FROM m",
    "frame_first_window": f"""WITH {F_SQL}, {_N},
w AS (SELECT clip_id, n, unnest(range(0, (n - 20) // 5 + 1)) * 5 AS "start" FROM (SELECT DISTINCT clip_id, n FROM fn WHERE n >= 20)),
s AS (SELECT w.clip_id, "start", avg((label = 'view')::DOUBLE) AS share FROM w JOIN f ON f.clip_id = w.clip_id AND f.frame >= "start" AND f.frame < "start" + 20 GROUP BY ALL)
SELECT clip_id, min("start") AS "start", round(arg_min(share, "start"), 8) AS share FROM s WHERE share >= 0.3 GROUP BY clip_id""",
    "frame_paint": f"""WITH {F_SQL},
s AS (SELECT clip_id, frame AS ord, frame + floor(value)::BIGINT % 7 AS until, label FROM f),
b AS (SELECT f.clip_id, f.frame, arg_max(s.label, s.ord) AS label FROM f JOIN s ON s.clip_id = f.clip_id AND f.frame >= s.ord AND f.frame < s.until GROUP BY ALL)
SELECT f.clip_id, f.frame, coalesce(b.label, 'sil') AS label FROM f LEFT JOIN b ON b.clip_id = f.clip_id AND b.frame = f.frame""",
    "frame_deltas": f"""WITH {F_SQL}, d AS (SELECT clip_id, frame, ({' + '.join(f'{k} * (lead(value, {k}) {_P} - lag(value, {k}) {_P})' for k in range(1, 5))}) / 60 AS delta FROM f)
SELECT clip_id, frame, round(delta, 6) AS delta FROM d WHERE delta IS NOT NULL""",
    "frame_resample": f"""WITH {F_SQL}, {_N},
p AS (SELECT clip_id, n, unnest(range(0, least(n, 25))) AS k FROM (SELECT DISTINCT clip_id, n FROM fn)),
x AS (SELECT *, CASE WHEN n > 25 THEN k * (n - 1) / 24.0::DOUBLE ELSE k::DOUBLE END AS x FROM p),
l AS (SELECT *, floor(x)::BIGINT AS lo, least(floor(x)::BIGINT + 1, n - 1) AS hi FROM x)
SELECT l.clip_id, k, round(a.value + (b.value - a.value) * (x - lo), 6) AS value
FROM l JOIN f a ON a.clip_id = l.clip_id AND a.frame = lo JOIN f b ON b.clip_id = l.clip_id AND b.frame = hi""",
    "frame_padded_deltas": f"""WITH {F_SQL}, {_N}, w(k, slope, bend) AS (VALUES {_padded_weights()}),
a AS (SELECT *, least(greatest(frame - 4, 0), n - 9) AS low FROM fn WHERE n >= 9),
m AS (SELECT a.clip_id, a.frame, sum(b.value * slope) AS d, sum(b.value * bend) AS d2
      FROM a CROSS JOIN w JOIN f b ON b.clip_id = a.clip_id AND b.frame = a.low + w.k GROUP BY ALL)
SELECT clip_id, frame, round(d, 6) + 0.0::DOUBLE AS delta, round(d2, 6) + 0.0::DOUBLE AS delta2 FROM m""",
    "frame_rescaled_path": f"""WITH {F_SQL}, {_N}, l AS (SELECT DISTINCT clip_id, n, n // 2 + 1 AS m FROM fn), s AS (SELECT unnest(range(0, 20)) AS step)
SELECT clip_id, step, CASE WHEN greatest(n, m) > 20 THEN round_even(step * (n / 20.0::DOUBLE), 0)::BIGINT ELSE step END AS i,
  CASE WHEN greatest(n, m) > 20 THEN round_even((step // 2) * (m / 20.0::DOUBLE), 0)::BIGINT ELSE step // 2 END AS j FROM l, s""",
    "frame_index": f"WITH {F_SQL} SELECT clip_id, frame, trunc(value / 0.01::DOUBLE)::INT AS at FROM f",
    "frame_counts_report": f"WITH {F_SQL} SELECT count(*) AS n, {', '.join(f"count(*) FILTER (label = '{c}') AS n_{c}" for c in CLASSES)} FROM f",
    "sig_cross_fade": f"""WITH {F_SQL}, {_N}, l AS (SELECT DISTINCT clip_id, n FROM fn),
s AS (SELECT l.clip_id, b.frame + n - 5 AS frame, b.value, n FROM l JOIN f b ON b.clip_id = l.clip_id + 1),
p AS (SELECT clip_id, frame, value * (1 - least(greatest((frame - n + 5.5) / 5, 0.0), 1.0)) AS part FROM fn
      UNION ALL SELECT clip_id, frame, value * least(greatest((frame - n + 5.5) / 5, 0.0), 1.0) FROM s)
SELECT clip_id, frame, round(sum(part), 6) AS value FROM p GROUP BY ALL""",
    "sig_mean_power": f"WITH {F_SQL} SELECT clip_id, round(sqrt(avg(value * value) + 1e-12), 6) AS rms FROM f GROUP BY clip_id",
    "sig_head_slice": f"WITH {F_SQL} SELECT clip_id, frame, round(value - avg(value) OVER (PARTITION BY clip_id), 6) AS value FROM f WHERE frame < 20",
    "eval_boundary_hits": f"""WITH {F_SQL}, {_TR},
g AS (SELECT clip_id, frame AS g FROM tr), p AS (SELECT clip_id, frame + 2 AS p FROM tr WHERE to_label = 'view'),
h AS (SELECT g.*, EXISTS (SELECT 1 FROM p WHERE p.clip_id = g.clip_id AND abs(p.p - g.g) <= 1) AS hit FROM g)
SELECT count(*) AS n_gold, count(*) FILTER (hit) AS hits, round(CASE WHEN count(*) = 0 THEN 1.0 ELSE count(*) FILTER (hit) / count(*) END, 8) AS hit_rate FROM h""",
    "eval_overlap_join": f"""WITH {F_SQL.replace("f AS", "g AS", 1)}, f AS (SELECT clip_id, frame, (label = 'view')::VARCHAR AS label, value FROM g), {_RUNS},
w AS (SELECT clip_id, frame AS w_id, frame * 0.01::DOUBLE AS a, frame * 0.01::DOUBLE + least(value, 50.0::DOUBLE) / 100 AS b FROM f),
s AS (SELECT clip_id, seg_id AS s_id, "start" AS c, "end" AS d FROM runs),
o AS (SELECT w.clip_id, w_id, s_id, greatest(0.0::DOUBLE, least(b, d) - greatest(a, c)) AS overlap FROM w JOIN s ON s.clip_id = w.clip_id)
SELECT clip_id, w_id, s_id, round(overlap, 6) AS overlap FROM o WHERE overlap > 0.05::DOUBLE""",
    "sig_peak_norm": f"""WITH {F_SQL},
a AS (SELECT clip_id, frame, value * power(10::DOUBLE, -3.0::DOUBLE / 20) / (max(abs(value)) OVER (PARTITION BY clip_id) + 1e-9::DOUBLE) AS value FROM f),
b AS (SELECT *, max(abs(value)) OVER (PARTITION BY clip_id) + 1e-9::DOUBLE AS peak FROM a)
SELECT clip_id, frame, round(CASE WHEN peak > 0.5::DOUBLE THEN value / peak * 0.4::DOUBLE ELSE value END, 8) AS value FROM b""",
    "sig_energy_mask": f"""WITH {F_SQL}, m AS (SELECT *, max(value) OVER (PARTITION BY clip_id) AS top FROM f)
SELECT clip_id, frame, value FROM m WHERE 20 * log10(value / (top + 1e-12) + 1e-12) > -20.0""",
    "sig_blend": f"WITH {F_SQL} SELECT a.clip_id, a.frame, round(0.85::DOUBLE * a.value + (1 - 0.85::DOUBLE) * b.value, 6) AS value FROM f a JOIN f b ON b.clip_id = a.clip_id + 1 AND b.frame = a.frame",
    "sig_snr_sweep": f"""WITH {F_SQL},
z AS (SELECT clip_id, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-6) AS x FROM f WINDOW w AS (PARTITION BY clip_id)),
e AS (SELECT col0::DOUBLE AS epsilon FROM (VALUES (0.01), (0.05), (0.1), (0.25), (0.5), (1.0), (2.0), (5.0)))
SELECT clip_id, epsilon, round(10 * log10((avg(x * x) + 1e-12) / (avg(epsilon * epsilon * sign(x) * sign(x)) + 1e-12)), 5) + 0.0::DOUBLE AS snr_db,
  round(avg((sign(x - epsilon * sign(x)) <> sign(x))::DOUBLE), 8) AS flipped FROM z, e GROUP BY ALL""",
    "sig_semitones": f"""WITH {F_SQL} SELECT clip_id, frame, round(CASE WHEN value * 4 > 50 THEN greatest(least(12 * log2(value * 4 / 110.0::DOUBLE), 6.0), -6.0) ELSE 0.0 END, 6) AS semitones FROM f""",
}
