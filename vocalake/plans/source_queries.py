"""Queries on transcripts as documents, positional joins and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from vocalake.functions.text import tokenize
from vocalake.operators import joins
from vocalake.plans.frame_queries import F_SQL, series
from vocalake.session import shared_path
from vocalake.sources import transcripts as tr
from vocalake.sources.tables import table
from vocalake.streaming import frames as sf


def _documents(spark, sf_dir):
    """Each conversation as a transcript: a turn is a segment of ten seconds, its words are spread over it."""
    rows = table(spark, sf_dir, "conversations")
    t = F.split("text", r"\s+")
    words = F.transform(t, lambda w, i: F.struct(w.alias("w"), (F.col("turn") * 10.0 + i / F.size(t) * 10).alias("s"), (F.col("turn") * 10.0 + (i + 1) / F.size(t) * 10).alias("e"), F.lit(1.0).alias("p")))
    seg = F.struct((F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 10.0).alias("end"), "text", F.lit(-0.5).alias("avg_logprob"), F.lit(0.0).alias("no_speech_prob"), words.alias("words"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(seg)).alias("segments"), (F.count("*") * 10.0).alias("duration"))
    return whole.select("conv_id", F.to_json(F.struct(F.lit("en").alias("language"), F.lit(1.0).alias("language_probability"), "duration", "segments")).alias("json"))


def transcript_text(spark, sf_dir):
    """Transcripts through JSON to plain text."""
    rows = tr.parse_transcripts(_documents(spark, sf_dir), "json")
    return rows.select("conv_id", "transcript.duration", F.md5(tr.plain_text(F.col("transcript.segments"))).alias("digest"))


def transcript_words(spark, sf_dir):
    rows = tr.parse_transcripts(_documents(spark, sf_dir), "json").select("conv_id", "transcript.segments")
    each = tr.words(rows, "conv_id")
    return each.groupBy("conv_id", "seg").agg(F.count("*").alias("n_words"), F.round(F.max("e"), 6).alias("last"))


def zip_join(spark, sf_dir):
    """Tokens of each turn of a conversation against those of the next, by place."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", tokenize(F.col("text")).alias("t"))
    first = rows.select("conv_id", "turn", F.col("t").alias("a"))
    second = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("b"))
    return joins.zipped(first, second, ["conv_id", "turn"], "a", "b")


def path_gather(spark, sf_dir):
    """Each user's series along the path i -> i // 2: the later step of a place wins."""
    own = series(spark, sf_dir)
    path = own.select("clip_id", F.col("frame").alias("step"), F.col("frame").alias("i"), F.expr("frame div 2").alias("j"))
    return joins.gathered(path, own, "clip_id")


def stream_windows(spark, sf_dir):
    """The events as a stream, in sliding windows; each batch's complete result replaces the last."""
    rows = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may be a file or a folder
    out = sf.finished(sf.sliding(sf.with_time(stream)), shared_path(spark, "stream-windows"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "label", "n", F.round("total", 4).alias("total"))


QUERIES = {
    "src_transcript_text": transcript_text,
    "src_transcript_words": transcript_words,
    "join_zip": zip_join,
    "join_path_gather": path_gather,
    "stream_windows": stream_windows,
}
_TOKENS = "regexp_extract_all(lower(text), '[A-Za-z\\x{0900}-\\x{097F}]+')"
SQL = {
    "src_transcript_text": "SELECT conv_id, count(*) * 10.0::DOUBLE AS duration, md5(string_agg(text, ' ' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id",
    "src_transcript_words": """WITH s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seg, turn, len(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+')) AS n FROM conversations)
SELECT conv_id, seg::INT AS seg, n AS n_words, turn * 10.0::DOUBLE + 10 AS last FROM s""",
    "join_zip": f"""WITH t AS (SELECT conv_id, turn, {_TOKENS} AS t FROM conversations),
u AS (SELECT conv_id, turn, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS pos FROM t)
SELECT a.conv_id, a.turn, a.pos::INT AS pos, a.w AS a, b.w AS b FROM u a JOIN u b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.pos = a.pos""",
    "join_path_gather": f"WITH {F_SQL} SELECT clip_id, frame // 2 AS j, arg_max(value, frame) AS value FROM f GROUP BY ALL",
    "stream_windows": """WITH w AS (SELECT *, unnest(range(0, 2)) AS back FROM events),
k AS (SELECT time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - back * INTERVAL 2 HOUR AS s, event_type AS label, value FROM w)
SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, label, count(*) AS n, round(sum(value), 4) AS total FROM k GROUP BY ALL""",
}
