"""Line deduplication by pairwise alignment of documents that share rare lines."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, _mix, _powers, text_of, written

#: A block is deleted only if its lines have so many characters together; shorter ones occur by chance.
MIN_CHARS = 20
#: Later documents of one first holder that one task aligns, about.
TOGETHER = 2000


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, in order of the first, in which the second rises too (patience sorting)."""
    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        back.append(last[at - 1] if at else -1)
        if at == len(tops):
            tops.append(y)
            last.append(k)
        else:
            tops[at], last[at] = y, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions: common head and tail, then lines unique to both as anchors, then between anchors."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: k for k, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        anchors = _rising([(k, place[x]) for k, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in place])
        if not anchors:
            continue
        ends = [*anchors, (a1, b1)]
        at = (a0, b0)
        for i, j in ends:
            todo.append((at[0], i, at[1], j))
            at = (i + 1, j + 1)
        found += anchors
    return sorted(found)


def common_blocks(pairs: list[tuple[int, int]], chars: list[int], least: int = MIN_CHARS) -> list[int]:
    """Positions in the first document of aligned blocks that have characters enough to tell."""
    out: list[int] = []
    block: list[int] = []
    before = None
    for i, j in [*pairs, (-9, -9)]:
        if before is None or (i, j) != (before[0] + 1, before[1] + 1):
            if block and sum(chars[k] for k in block) >= least:
                out += block
            block = []
        block.append(i)
        before = (i, j)
    return out


def windows(hashes: np.ndarray, chars: np.ndarray, least: int = MIN_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (exclusive) and 64-bit codes of the least runs of lines that tell two documents have a block in common:
    from every line on, and up to every line, the shortest run with `least` characters. Every line of a common block
    stands in such a run within the block.
    """
    n, at = len(hashes), np.arange(len(hashes))
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(chars, dtype=np.int64)))
    until = np.maximum(np.searchsorted(total, total[:-1] + least, "left"), at + 1)
    since = np.minimum(np.searchsorted(total, total[1:] - least, "right") - 1, at)
    start, end = np.concatenate((at[until <= n], since[since >= 0])), np.concatenate((until[until <= n], at[since >= 0] + 1))
    up, down = _powers(max(n, 1))
    with np.errstate(over="ignore"):
        summed = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes.astype(np.uint64) * up[:n], dtype=np.uint64)))
        code = (summed[end] - summed[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
    return start, end, _mix(code).astype(np.int64)


def lost_lines(a: np.ndarray, chars: np.ndarray, b: np.ndarray, other: np.ndarray, least: int = MIN_CHARS) -> np.ndarray:
    """Positions in a of all blocks in common with b: those that patience diff aligns, and then those that stand in b in
    another order or more than once, which no single alignment can match.
    """
    lost = np.zeros(len(a), bool)
    lost[common_blocks(patience(a.tolist(), b.tolist()), chars.tolist(), least)] = True
    if not (np.isin(a, b) & ~lost).any():
        return np.flatnonzero(lost)
    start, end, code = windows(a, chars, least)
    here = np.isin(code, windows(b, other, least)[2])
    step = np.zeros(len(a) + 1, np.int64)
    np.add.at(step, start[here], 1)
    np.add.at(step, end[here], -1)
    return np.flatnonzero(lost | (np.cumsum(step)[:-1] > 0))


def aligned_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Line numbers to delete, a row for each document that loses lines: id, key (of the text), lines.

    Documents are linked by one hash of their lines and aligned by another, so that a collision deletes nothing.
    """
    me, key, first, salt = P + "id", P + "key", P + "first", P + "salt"
    lines = F.split(text_of(text_col), "\n")
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias(me), F.xxhash64(text_of(text_col)).alias(key), F.transform(lines, lambda x: F.trim(x)).alias(P + "lines"))
    each = lambda f: F.transform(P + "lines", f)
    rows = rows.select(me, key, each(lambda x: F.xxhash64(x)).alias(P + "hash"), each(lambda x: F.xxhash64(x, F.lit(1))).alias(P + "check"), each(lambda x: F.least(F.length(x), F.lit(min_chars))).alias(P + "chars"))
    rows = written(rows, "lines")
    kind = docs.schema[id_col].dataType.simpleString()

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(windows(_values(h), _values(c), min_chars)[2]) for h, c in zip(b.column(1), b.column(2), strict=True)]
            row = np.repeat(np.arange(b.num_rows), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], names=[me, P + "h"])

    told = rows.select(me, P + "hash", P + "chars").mapInArrow(tell, f"{me} {kind}, {P}h long")
    # The first holder stands for all documents that share a run: one link for each run and document, whatever the run's
    # frequency, so no line is too common and no group yields all its pairs. Of a block in common with any earlier
    # document every line stands in such a run, whose first holder is aligned too.
    shared = written(told.groupBy(P + "h").agg(F.min(me).alias(first), F.max(me).alias(P + "last")).filter(F.col(first) != F.col(P + "last")).drop(P + "last"), "shared")
    pairs = written(told.join(shared, P + "h").filter(F.col(me) != F.col(first)).select(me, first).distinct(), "pairs")
    # The first holder of a very common line meets its later documents in several places: it is copied there.
    heavy = written(pairs.groupBy(first).agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("places")).filter("places > 1"), "heavy")
    pairs = pairs.join(heavy, first, "left").select(me, first, F.when(F.col("places").isNull(), 0).otherwise(F.pmod(F.xxhash64(me), F.col("places"))).cast("int").alias(salt))
    other = rows.select(F.col(me).alias(first), F.col(P + "check").alias(P + "other"), F.col(P + "chars").alias(P + "others")).join(heavy, first, "left")
    other = other.select(first, P + "other", P + "others", F.explode(F.sequence(F.lit(0), F.coalesce("places", F.lit(1)) - 1)).alias(salt))
    both = pairs.join(rows.select(me, key, P + "check", P + "chars"), me).join(other, [first, salt]).select(me, key, P + "check", P + "chars", P + "other", P + "others")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lost = [lost_lines(*map(_values, x), min_chars).astype(np.int32) for x in zip(*b.columns[2:], strict=True)]
            out = pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(lost, pa.list_(pa.int32()))], names=[me, key, P + "lost"])
            yield out.filter(pa.array([len(x) > 0 for x in lost], pa.bool_()))

    aligned = both.mapInArrow(align, f"{me} {kind}, {key} long, {P}lost array<int>")
    return aligned.groupBy(me, key).agg(F.array_distinct(F.flatten(F.collect_list(P + "lost"))).alias(P + "lost"))


def _values(x: pa.ListScalar) -> np.ndarray:
    return x.values.to_numpy()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, prefix: str = "") -> DataFrame:
    """docs with aligned common blocks deleted from the later (higher id) document, and n_lines, n_deleted under names that
    begin with `prefix` (columns of docs with these names are replaced).

    Rare lines are those that two or more documents have; the shortest runs of lines with `min_chars` characters link
    their later documents to their first holder. A document is aligned with every first holder of its runs by patience
    diff on line hashes, then what is left by runs that moved, so that every block of `min_chars` characters in common
    with any earlier document goes; blank ends of lines do not count. The first holder of a block never loses it, so no
    such content is lost altogether.

    Rows with a null id, null or empty text stay as they are. Rows that repeat an id are one document: they are not
    aligned with each other. A text all of whose lines go becomes empty. Very long texts are aligned whole. An empty
    table gives an empty result.
    """
    n_lines, n_deleted = prefix + "n_lines", prefix + "n_deleted"
    lost = written(aligned_lines(docs, id_col, text_col, min_chars), "lost").withColumnRenamed(P + "id", P + "id2").withColumnRenamed(P + "key", P + "key2")
    keyed = docs.withColumn(P + "key", F.xxhash64(text_of(text_col)))
    joined = keyed.join(lost, (F.col(id_col) == F.col(P + "id2")) & (F.col(P + "key") == F.col(P + "key2")), "left")
    lines, gone = F.split(F.col(text_col), "\n"), F.col(P + "lost")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.when(gone.isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    counts = [F.size(F.split(text_of(text_col), "\n")).cast("long").alias(n_lines), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_deleted)]
    return joined.select(*[(text.alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns if c not in (n_lines, n_deleted)], *counts)
