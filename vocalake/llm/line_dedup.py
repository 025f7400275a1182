"""Line dedup by site-relative frequency, in DataFrame functions only.

For each host, the pages that hold a line are divided by the host's pages; a line above the ratio is
boilerplate of that host and goes from its pages. Lines are compared without white space at their
ends; blank lines are never counted and always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalake.llm.common import SPACE_CHARS, WORD, materialised, text_of

#: A line on more than this share of a host's pages is boilerplate there, if on MIN_PAGES at least: one page in twenty
#: is more than chance or a few copies bring, and two pages of a small host may be copies of each other.
RATIO = 0.05
MIN_PAGES = 3
#: Boilerplate lines of all hosts up to this number (8 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_LINES = 1_000_000


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(SPACE_CHARS)))


def boilerplate(docs: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host_key, bad, n): hashes of the boilerplate lines of each host that has any.

    Hosts and lines are counted by 64-bit hashes with partial aggregation, so that neither a hot host
    nor a hot line meets in one task. A host has fewer boilerplate lines than the mean number of lines
    on its pages divided by ratio, which bounds `bad`.
    """
    lines = F.filter(F.split(text_of(text), "\n"), lambda line: line.rlike(WORD))
    keyed = docs.select(F.xxhash64(host).alias("host_key"), F.array_distinct(F.transform(lines, _line_hash)).alias("lines"))
    totals = keyed.groupBy("host_key").agg(F.count("*").alias("pages"))
    seen = (
        keyed.select("host_key", F.explode("lines").alias("line"))
        .groupBy("host_key", "line")
        .agg(F.count("*").alias("holding"))
        .filter(F.col("holding") >= min_pages)
    )
    return (
        seen.join(totals, "host_key")
        .filter(F.col("holding") > F.lit(float(ratio)) * F.col("pages"))
        .groupBy("host_key")
        .agg(F.collect_set("line").alias("bad"))
        .withColumn("n", F.size("bad"))
    )


def drop_boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """Every row of docs, its text without the boilerplate lines of its host, in the order of docs' columns.

    The other lines keep their order and bytes; a text that loses no line is unchanged, one that
    loses all becomes empty, and a null text stays null. Rows with a null host form one host. No row
    is dropped; repeated rows count as pages of their own and are cleaned alike; an empty table gives
    an empty table. Adds no column: clean_lines gives the number of lines dropped too.
    """
    return clean_lines(docs, F.col(f"`{host}`"), text, ratio, min_pages).select("row.*").select(*[F.col(f"`{c}`") for c in docs.columns])


def clean_lines(docs: DataFrame, host: Column, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(row, n_dropped): row has docs' columns with the cleaned text."""
    bad = materialised(boilerplate(docs, host, F.col(f"`{text}`"), ratio, min_pages), "boilerplate")
    n_lines = bad.agg(F.sum("n")).first()[0] or 0
    if n_lines <= BROADCAST_LINES:
        bad = F.broadcast(bad)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    df = docs.select(row.alias("row"), F.xxhash64(host).alias("key"), F.col(f"`{text}`").alias("txt"))
    df = df.join(bad, df["key"] == bad["host_key"], "left")
    good = F.filter(F.split("txt", "\n"), lambda line: ~line.rlike(WORD) | ~F.array_contains("bad", _line_hash(line)))
    df = df.select("row", "txt", F.when(F.col("bad").isNotNull() & F.col("txt").isNotNull(), good).alias("good"))
    dropped = F.coalesce(F.size(F.split("txt", "\n")) - F.size("good"), F.lit(0)).cast("long")
    df = df.select("row", F.when(F.col("good").isNull(), F.lit(0).cast("long")).otherwise(dropped).alias("n_dropped"), "txt", "good")
    cleaned = F.when(F.col("n_dropped") > 0, F.array_join("good", "\n")).otherwise(F.col("txt"))
    return df.select(F.col("row").withField(f"`{text}`", cleaned).alias("row"), "n_dropped")
