"""What the operators of this subpackage share: scratch tables, names, views of Arrow text."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Prefix of every internal column, so that columns of the caller never clash with ours.
P = "__lf_"

_own_folder: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset a folder of our own, on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="lumenflow-"))
        base = _own_folder[0]
    return f"{base.rstrip('/')}/lumenflow-{spark.sparkContext.applicationId}"


_written: list[str] = []


def written(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write df to the shared folder, a folder for each value of `by`, and read it back: cuts lineage, survives lost executors.

    The table is the input of later plans, so its true size is known to the optimizer.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_tables() -> list[str]:
    """Paths of the scratch tables that stand, in order of writing; the last is that of the last `written`."""
    return list(_written)


def release(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables: of the given paths, or all of this application. Nothing may read them afterwards."""
    for path in paths or (scratch_root(spark),):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _written[:] = [p for p in _written if p not in paths] if paths else []


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its offsets (n + 1); null counts as empty. No copy is made."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n, start = len(column), column.offset
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[start : start + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, most: int):
    """Row ranges of at most `most` bytes each; a longer row is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWER = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_POWER), -1, 1 << 64))
    up, down = np.full(n, _POWER, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


_table: list[tuple[np.ndarray, np.ndarray]] = []


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(29))
        x = x * np.uint64(0xA0761D6478BD642F)
        return x ^ (x >> np.uint64(32))


def word_hashes(raw: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the runs of bytes that are not white space; no run crosses a cut.

    A prefix sum of byte times power gives every word's polynomial hash at once.
    """
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    solid = ~_SPACE[raw]
    fresh = np.ones(len(raw) + 1, bool)
    fresh[1:-1] = ~solid[:-1]
    last = np.ones(len(raw) + 1, bool)
    last[1:-1] = ~solid[1:]
    if cuts is not None and len(cuts):
        fresh[cuts] = True
        last[cuts] = True
    start, stop = np.flatnonzero(fresh[:-1] & solid), np.flatnonzero(last[1:] & solid) + 1
    if not _table or len(_table[0][0]) < len(raw):
        _table[:] = [_powers(max(len(raw), 1 << 16))]
    up, down = _table[0]
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)))
        poly = (total[stop] - total[start]) * down[start]
        return start, _mix(poly + (stop - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def words_by_row(raw: np.ndarray, offsets: np.ndarray, piece: int = 1 << 20):
    """(first row, word hashes of these rows, counts by row), in memory bounded by `piece` and one row's words."""
    for i, j in runs(offsets, piece):
        if offsets[j] - offsets[i] <= piece:
            cut = offsets[i : j + 1] - offsets[i]
            start, found = word_hashes(raw[offsets[i] : offsets[j]], cut)
            yield i, found, np.diff(np.searchsorted(start, cut))
        else:
            row, found, at = raw[offsets[i] : offsets[j]], [], 0
            while at < len(row):
                end = min(at + piece, len(row))
                if end < len(row):
                    blank = np.flatnonzero(_SPACE[row[at:end]])
                    if len(blank):
                        end = at + int(blank[-1]) + 1
                    else:
                        more = np.flatnonzero(_SPACE[row[end:]])
                        end = end + int(more[0]) + 1 if len(more) else len(row)
                found.append(word_hashes(row[at:end])[1])
                at = end
            found = np.concatenate(found)
            yield i, found, np.array([len(found)], np.int64)
