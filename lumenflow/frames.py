"""Frames: one image a row, its pixels as bytes. A frame is processed whole in the task that reads it.

Columns: frame_id, width, height, channels, format, timestamp_us, source_id, data. Pixels are row-major
and interleaved; `format` is Mono8, RGB8, BGR8, RGBA8, BGRA8, Mono16 or Float32.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import settled
from .shipping import ship

SCHEMA = "frame_id long, width int, height int, channels int, format string, timestamp_us long, source_id string, data binary"
KINDS = {"Mono16": np.dtype("<u2"), "Float32": np.dtype("<f4")}


def image_of(row: dict) -> np.ndarray:
    """height x width x channels; a view of the bytes."""
    kind = KINDS.get(row["format"], np.dtype(np.uint8))
    return np.frombuffer(row["data"], kind).reshape(row["height"], row["width"], row["channels"])


def _row(row: dict, image: np.ndarray) -> dict:
    image = np.ascontiguousarray(image if image.ndim == 3 else image[:, :, None])
    channels = image.shape[2]
    kind = {np.dtype("<u2"): "Mono16", np.dtype("<f4"): "Float32"}.get(image.dtype)
    if kind is None:
        kind = row["format"] if channels == row["channels"] and row["format"] not in KINDS else {1: "Mono8", 3: "RGB8", 4: "RGBA8"}[channels]
    return row | {"width": image.shape[1], "height": image.shape[0], "channels": channels, "format": kind, "data": image.tobytes()}


def map_images(frames: DataFrame, *steps: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply functions of one image, one after the other, in a single pass over the frames.

    Rows whose data is null stay null. A frame's memory is bounded by its own size.
    """
    ship(frames.sparkSession)
    schema = frames.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                if row["data"] is not None:
                    image = image_of(row)
                    for step in steps:
                        image = step(image)
                    row = _row(row, image)
                yield pa.RecordBatch.from_pylist([row], schema=b.schema)

    return frames.mapInArrow(run, schema)


def measure_images(frames: DataFrame, step: Callable[[np.ndarray], dict | list[dict]], fields: str) -> DataFrame:
    """A row per frame (or per item that `step` lists) with frame_id and `fields`."""
    ship(frames.sparkSession)
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                if row["data"] is None:
                    continue
                got = step(image_of(row))
                got = got if isinstance(got, list) else [got]
                if got:
                    yield pa.RecordBatch.from_pydict({"frame_id": pa.array([row["frame_id"]] * len(got), pa.int64())} | {n: _typed([g[n] for g in got], k.split()[1]) for n, k in zip(names, fields.split(", "), strict=True)})

    return frames.mapInArrow(run, f"frame_id long, {fields}")


def _typed(values: list, kind: str) -> pa.Array:
    return pa.array(values, {"double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[kind])


def pair_images(a: DataFrame, b: DataFrame, step: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Frames of `a` joined with those of `b` by frame_id. Frames of different sizes give none."""
    ship(a.sparkSession)
    other = b.select("frame_id", F.struct("width", "height", "channels", "format", "data").alias("other"))
    joined = a.join(other, "frame_id").filter((F.col("width") == F.col("other.width")) & (F.col("height") == F.col("other.height")) & (F.col("channels") == F.col("other.channels")))
    schema = a.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                second = row.pop("other")
                if row["data"] is not None and second["data"] is not None:
                    row = _row(row, step(image_of(row), image_of(second)))
                yield pa.RecordBatch.from_pylist([{c: row[c] for c in schema.names}], schema=pa.schema([batch.schema.field(c) for c in schema.names]))

    return joined.select(*a.columns, "other").mapInArrow(run, schema)


def to_pixels(frames: DataFrame) -> DataFrame:
    """(frame_id, y, x, c, v): the relational form, a row per sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                if row["data"] is None:
                    continue
                image = image_of(row)
                y, x, c = (k.ravel().astype(np.int32) for k in np.indices(image.shape))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(image.size, row["frame_id"])), pa.array(y), pa.array(x), pa.array(c), pa.array(image.ravel().astype(np.float64))], names=["frame_id", "y", "x", "c", "v"])

    return frames.mapInArrow(run, "frame_id long, y int, x int, c int, v double")


def from_pixels(pixels: DataFrame) -> DataFrame:
    """Frames from a complete table of 8-bit pixels (frame_id, y, x, c, v): each row of a frame is put together where its
    samples meet, then the rows where the frame's meet, as bytes.
    """
    ship(pixels.sparkSession)
    line = F.transform(F.sort_array(F.collect_list(F.struct("x", "c", F.col("v").cast("short").alias("v")))), lambda s: s["v"])
    lines = pixels.groupBy("frame_id", "y").agg((F.max("x") + 1).cast("int").alias("width"), (F.max("c") + 1).cast("int").alias("channels"), line.alias("line"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [np.asarray(v.values).astype(np.uint8).tobytes() for v in b.column(4)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(data, pa.binary())], names=[*b.schema.names[:4], "line"])

    lines = lines.select(F.col("frame_id").cast("long"), F.col("y").cast("int").alias("y"), "width", "channels", "line").mapInArrow(packed, "frame_id long, y int, width int, channels int, line binary")
    rows = lines.groupBy("frame_id").agg(F.max("width").alias("width"), (F.max("y") + 1).cast("int").alias("height"), F.max("channels").alias("channels"), F.sort_array(F.collect_list(F.struct("y", "line"))).alias("p"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [b"".join(x["line"] for x in v.as_py()) for v in b.column(4)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(data, pa.binary())], names=[*b.schema.names[:4], "data"])

    rows = rows.mapInArrow(joined, "frame_id long, width int, height int, channels int, data binary")
    kind = F.when(F.col("channels") == 1, "Mono8").when(F.col("channels") == 3, "RGB8").otherwise("RGBA8")
    return rows.select("frame_id", "width", "height", "channels", kind.alias("format"), F.lit(0).cast("long").alias("timestamp_us"), F.lit("").alias("source_id"), F.col("data"))


def gradient_frames(spark: SparkSession, count: int, width: int, height: int) -> DataFrame:
    """Synthetic frames, a horizontal ramp each."""
    ids = spark.range(count).select(F.col("id").alias("frame_id"), F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(1).alias("channels"), F.lit("Mono8").alias("format"), (F.col("id") * 33333).alias("timestamp_us"), F.lit("synthetic").alias("source_id"), F.unhex(F.lit("")).alias("data"))

    def ramp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = (np.arange(width) * 255 // max(width - 1, 1)).astype(np.uint8)
        data = np.tile(line, height).tobytes()
        for b in batches:
            for i in range(b.num_rows):
                yield pa.RecordBatch.from_pylist([b.slice(i, 1).to_pylist()[0] | {"data": data}], schema=b.schema)

    return ids.mapInArrow(ramp, SCHEMA)


#: Bytes of templates that are broadcast at a time.
PART_BYTES = 64 << 20


def against_all(a: DataFrame, other: DataFrame) -> DataFrame:
    """Each row of `a` beside each of `other`, whose size is known once it is written: one pass over `a` for every part."""
    other = settled(other, "templates")
    size = other.agg(F.sum(F.length("other.data"))).first()[0] or 0
    parts = -(-size // PART_BYTES) or 1
    out = None
    for k in range(parts):
        part = other if parts == 1 else other.filter(F.pmod(F.xxhash64("other_id"), F.lit(parts)) == k)
        each = a.join(F.broadcast(part), F.lit(True))
        out = each if out is None else out.unionByName(each)
    return out


def measure_pairs(a: DataFrame, b: DataFrame, step: Callable[[np.ndarray, np.ndarray], dict | list[dict]], fields: str, every: bool = False) -> DataFrame:
    """A row for each item that `step` gives for frames of equal id; with `every`, for all frames of `a` against each of
    `b` (templates), which are written, measured and broadcast in parts of at most PART_BYTES.
    """
    ship(a.sparkSession)
    other = b.select(F.col("frame_id").alias("other_id"), F.struct("width", "height", "channels", "format", "data").alias("other"))
    joined = against_all(a, other) if every else a.join(other, F.col("frame_id") == F.col("other_id"))
    names, kinds = zip(*[f.split() for f in fields.split(", ")], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if row["data"] is None or row["other"]["data"] is None:
                    continue
                got = step(image_of(row), image_of(row["other"]))
                got = got if isinstance(got, list) else [got]
                if got:
                    head = {"frame_id": pa.array([row["frame_id"]] * len(got), pa.int64()), "other_id": pa.array([row["other_id"]] * len(got), pa.int64())}
                    yield pa.RecordBatch.from_pydict(head | {n: _typed([g[n] for g in got], k) for n, k in zip(names, kinds, strict=True)})

    return joined.mapInArrow(run, f"frame_id long, other_id long, {fields}")


def zip_images(inputs: list[DataFrame], step: Callable[..., np.ndarray]) -> DataFrame:
    """`step` of the frames of equal id of all inputs; a frame that one of them lacks gives none. The first one's other columns stay."""
    first = inputs[0]
    ship(first.sparkSession)
    joined = first
    for k, df in enumerate(inputs[1:]):
        joined = joined.join(df.select("frame_id", F.struct("width", "height", "channels", "format", "data").alias(f"__other{k}")), "frame_id")
    schema, names = first.schema, [f"__other{k}" for k in range(len(inputs) - 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                others = [row.pop(n) for n in names]
                if row["data"] is not None and all(o["data"] is not None for o in others):
                    row = _row(row, step(image_of(row), *map(image_of, others)))
                yield pa.RecordBatch.from_pylist([{c: row[c] for c in schema.names}], schema=pa.schema([batch.schema.field(c) for c in schema.names]))

    return joined.select(*first.columns, *names).mapInArrow(run, schema)
