"""Sinks: frames and results as tables or files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_frames(frames: DataFrame, path: str, by: str | None = None) -> None:
    """Frames as Parquet, which keeps sizes beside samples; optionally in a folder per value of `by`."""
    writer = frames.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def save_results(results: DataFrame, path: str, label: str = "Result") -> None:
    """Each row as a line of JSON under a label."""
    results.select(F.to_json(F.struct(F.lit(label).alias("label"), F.struct("*").alias("value"))).alias("value")).write.mode("overwrite").text(path)
