"""Sources: raw frames, images decoded by a caller's function, point-cloud files."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import SCHEMA


def raw_frames(spark: SparkSession, path: str, width: int, height: int, channels: int = 1, format: str = "Mono8") -> DataFrame:
    """A frame per file of plain samples; a file of another length is an error. Ids follow a hash of the path."""
    size = width * height * channels * {"Mono16": 2, "Float32": 4}.get(format, 1)
    files = spark.read.format("binaryFile").load(path)
    wrong = F.raise_error(F.concat(F.col("path"), F.lit(f" has not {size} bytes but "), F.col("length")))
    files = files.withColumn("content", F.when(F.col("length") == size, F.col("content")).otherwise(wrong.cast("binary")))
    return files.select(F.xxhash64("path").alias("frame_id"), F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(channels).alias("channels"), F.lit(format).alias("format"), F.expr("unix_micros(modificationTime)").alias("timestamp_us"), F.col("path").alias("source_id"), F.col("content").alias("data"))


def decoded_frames(spark: SparkSession, path: str, decode: Callable[[bytes], np.ndarray]) -> DataFrame:
    """A frame per file through `decode`, which gives height x width x channels of 8 bits."""

    def run(batches):
        for b in batches:
            for p, t, content in zip(b["path"], b["t"], b["content"], strict=True):
                image = np.atleast_3d(decode(content)).astype(np.uint8)
                h, w, c = image.shape
                yield pd.DataFrame([[0, w, h, c, {1: "Mono8", 3: "RGB8"}.get(c, "RGBA8"), t, p, image.tobytes()]], columns=[x.split()[0] for x in SCHEMA.split(", ")])

    files = spark.read.format("binaryFile").load(path).select("path", F.expr("unix_micros(modificationTime)").alias("t"), "content")
    return files.mapInPandas(run, SCHEMA).withColumn("frame_id", F.xxhash64("source_id"))


def point_cloud(spark: SparkSession, path: str, cloud_id: int = 0) -> DataFrame:
    """Points of ASCII PCD, PLY or XYZ files: every line of three or more numbers is one."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"), F.monotonically_increasing_id().alias("point_id"))
    number = r"^[-+]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?$"
    rows = lines.filter((F.size("p") >= 3) & F.forall(F.slice("p", 1, 3), lambda x: x.rlike(number)))
    return rows.select(F.lit(cloud_id).cast("long").alias("cloud_id"), "point_id", *[F.col("p")[k].cast("double").alias(a) for k, a in enumerate("xyz")])
