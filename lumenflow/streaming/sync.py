"""Streams of frames: synchrony of cameras, alignment, rates. Lateness is bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sync_windows(frames: DataFrame, time: str = "ts", camera: str = "camera_id", every: str = "1 second", late: str = "5 seconds", tolerance_us: float = 1000.0) -> DataFrame:
    """For each window: frames, cameras, the spread of their times and whether it is within the tolerance."""
    w = frames.withWatermark(time, late).groupBy(F.window(time, every))
    us = F.expr(f"timestampdiff(MICROSECOND, timestamp'1970-01-01 00:00:00', cast(`{time}` as timestamp))")
    s = w.agg(F.count("*").alias("frames"), F.approx_count_distinct(camera).alias("cameras"), (F.max(us) - F.min(us)).alias("spread_us"))
    return s.select(F.col("window.start").alias("start"), "frames", "cameras", "spread_us", (F.col("spread_us") <= tolerance_us).alias("synced"))


def pair_cameras(left: DataFrame, right: DataFrame, time: str = "ts", tolerance: str = "1 millisecond", late: str = "5 seconds") -> DataFrame:
    """Frames of one trigger from two streams: equal trigger_id, times within the tolerance of each other."""
    a = left.withWatermark(time, late).select(*[F.col(c).alias("l_" + c) for c in left.columns])
    b = right.withWatermark(time, late).select(*[F.col(c).alias("r_" + c) for c in right.columns])
    near = f"l_trigger_id = r_trigger_id AND r_{time} BETWEEN l_{time} - INTERVAL {tolerance} AND l_{time} + INTERVAL {tolerance}"
    return a.join(b, F.expr(near))


def frame_rate(frames: DataFrame, time: str = "ts", camera: str = "camera_id", every: str = "10 seconds", late: str = "5 seconds") -> DataFrame:
    """Frames a second of each camera."""
    w = frames.withWatermark(time, late).groupBy(F.window(time, every), camera).agg(F.count("*").alias("frames"))
    seconds = F.unix_timestamp("window.end") - F.unix_timestamp("window.start")
    return w.select(F.col("window.start").alias("start"), camera, "frames", (F.col("frames") / seconds).alias("fps"))
