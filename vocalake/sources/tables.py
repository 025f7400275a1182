"""Readers for the tables that queries take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder, by any path that Spark can open."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
