"""Frame operators on streams of events (ts timestamp, user_id, event_type, value)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def with_time(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events whose ts is a timestamp with a watermark; zone-less times are taken as the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def sliding(events: DataFrame, size: str = "4 hours", hop: str = "2 hours") -> DataFrame:
    """(start, label, n, total): counts and sums of each label in sliding windows."""
    grouped = events.groupBy(F.window("ts", size, hop).alias("w"), F.col("event_type").alias("label"))
    sums = grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("w.start").alias("start"), "label", "n", "total")


def finished(stream: DataFrame, path: str) -> DataFrame:
    """What an aggregating stream gives once it has taken all that is there: each batch's whole result replaces the
    last as files below path, so that nothing gathers on the driver."""
    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state")
    query = query.foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/rows")).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def run_lengths(events: DataFrame) -> DataFrame:
    """(user_id, label, n): runs of a user's equal labels, given out when the label changes.

    The state of a user is the open run; events are taken in the order of ts within a micro-batch.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        label, n = state.get if state.exists else (None, 0)
        out = []
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        for now in rows["event_type"]:
            if now == label:
                n += 1
                continue
            if n:
                out.append((key[0], label, n))
            label, n = now, 1
        state.update((label, n))
        yield pd.DataFrame(out, columns=["user_id", "label", "n"])

    return events.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, label string, n long", "label string, n long", "append", GroupStateTimeout.NoTimeout
    )
