"""What the operators share: the scratch folder, tables written between jobs, words, connected components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


_FALLBACK: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        found = _FALLBACK.get("folder") or _FALLBACK.setdefault("folder", tempfile.mkdtemp(prefix="vocalake-"))
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/vocalake/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialised(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a record batch on its way to a Python worker, about; a longer row goes alone.
BATCH_BYTES = 2 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(rows: DataFrame, batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """rows.mapInArrow, with batches cut by bytes, so that a worker's memory doesn't follow the length of texts.

    The session's own limit holds where it has set one.
    """
    conf = rows.sparkSession.conf
    if conf.get(_BATCH_LIMIT, None) is None:
        conf.set(_BATCH_LIMIT, str(BATCH_BYTES))
    return rows.mapInArrow(batches, schema)


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose cells of a text or binary column have `most` bytes together, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, low = np.cumsum(sizes, dtype=np.int64), 0
    while low < batch.num_rows:
        before = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(low, high - low)
        low = high


def regrouped(source: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches of about `most` bytes in a text or binary column, whatever their size was; at least one row each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in source:
        for part in slices(batch, column, most):
            own = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and size + own > most:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += own
    if held:
        yield pa.concat_batches(held)


def whole_runs(source: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by their first `keys` columns, cut anew so that rows of equal keys (no nulls) are in one batch."""
    held: list[pa.RecordBatch] = []
    for batch in source:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        changed = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0))
        if len(changed):
            cut = int(changed[-1]) + 1
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held and any(held[-1].column(k)[-1].as_py() != c[0] for k, c in enumerate(columns)):
            yield pa.concat_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.concat_batches(held)


def run_starts(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Where runs of equal keys begin, and the number of rows."""
    columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
    return np.r_[0, np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1, batch.num_rows]


def text_of(column: str | Column) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(column: str | Column) -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD + "+")).cast("long")


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores appended until no column is called that."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Links up to which a component step is one plain query.
PLAIN_LINKS = 1_000_000


def connected(edges: DataFrame, tag: str = "components", limit: int = 60) -> DataFrame:
    """Connected components of edges (a, b), by alternating large-star and small-star steps.

    Returns (node, root): one row per node of an edge, root the smallest node of its component. Every
    step is a shuffle with partial aggregation and is written to the shared folder; neither links nor
    components reach the driver, which only compares row counts and a hash sum. Beyond PLAIN_LINKS links
    the smallest neighbours are written before they are joined, so that the join is of two plain
    shuffles, of which Spark can split the partition of a node with very many neighbours; of fewer
    links such a partition is small, and the writing would cost more than it saves.
    """

    def stars(pairs: DataFrame, large: bool, many: bool) -> DataFrame:
        if large:
            pairs = pairs.union(pairs.select("b", "a").toDF("a", "b"))
        least = pairs.groupBy("a").agg(F.min("b").alias("least"))
        if many:
            least = materialised(least, tag)
        joined = pairs.join(least, "a").withColumn("m", F.least("a", "least"))
        if large:
            return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        moved = joined.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(least.toDF("a", "b")).distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    pairs = materialised(pairs, tag)
    before = state(pairs)
    for _ in range(limit if before[0] else 0):
        many = before[0] > PLAIN_LINKS
        pairs = materialised(stars(stars(pairs, True, many), False, many), tag)
        after = state(pairs)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {limit} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select(F.col("b"), F.col("b"))).distinct()
