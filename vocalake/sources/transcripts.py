"""Transcripts, dictionaries and text as tables, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSCRIPT = (
    "language string, language_probability double, duration double, segments array<struct<start: double, end: double, "
    "text: string, avg_logprob: double, no_speech_prob: double, words: array<struct<w: string, s: double, e: double, p: double>>>>"
)
DICTIONARY = "language string, language_name string, notes string, entries map<string, string>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file, with its path; fields that a file lacks are null."""
    return spark.read.schema(TRANSCRIPT).json(path, multiLine=True).withColumn("path", F.input_file_name())


def parse_transcripts(rows: DataFrame, column: str) -> DataFrame:
    """rows with a JSON column as the struct `transcript`."""
    return rows.withColumn("transcript", F.from_json(column, f"struct<{TRANSCRIPT}>"))


def segments(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys..., seg, start, end, text, avg_logprob, no_speech_prob, words): a row per segment."""
    return rows.select(*keys, F.posexplode("segments").alias("seg", "s")).select(*keys, "seg", "s.*")


def words(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys..., seg, pos, w, s, e, p): a row per word."""
    each = segments(rows, *keys)
    return each.select(*keys, "seg", F.posexplode("words").alias("pos", "x")).select(*keys, "seg", "pos", "x.*")


def plain_text(segments_: Column) -> Column:
    """The segments' texts with a blank between them."""
    return F.array_join(F.transform(segments_, lambda s: s["text"]), " ")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(term, gloss), terms in lower case."""
    rows = spark.read.schema(DICTIONARY).json(path, multiLine=True)
    return rows.select(F.explode("entries").alias("term", "gloss")).select(F.lower("term").alias("term"), "gloss")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't blank."""
    return spark.read.text(path).filter(F.col("value").rlike(r"\S"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first path that Spark finds."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(conf).exists(where):
            return path
    return None
