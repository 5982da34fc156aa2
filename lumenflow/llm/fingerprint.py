"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import P, _mix, text_of, words_by_row, written

SAMPLES = 128
_seeds: dict[int, tuple] = {}


def _seed(samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends, a pair for each sample."""
    if samples not in _seeds:
        rng = np.random.default_rng(20100815)
        mul, add = rng.integers(0, 1 << 63, (2, samples, 1), np.uint64)
        _seeds[samples] = (mul << np.uint64(1)) | np.uint64(1), add
    return _seeds[samples]


def _exponential(bits: np.ndarray, width: int) -> np.ndarray:
    """An exponential variate from `width` random bits."""
    return -np.log((bits.astype(np.float64) + 0.5) * 2.0**-width)


#: By sample: the least a, 16 bits of the term and level that have it, whether its weight is more than 1, and the term.
Least = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def least_terms(terms: np.ndarray, weights: np.ndarray, samples: int = SAMPLES, block: int = 256) -> Least:
    """For each sample the least of a weighted set of 64-bit terms in rising order; of equal ones that of weight 1, then the first.

    With r, c from Gamma(2, 1) and u uniform, a term of weight w has t = floor(ln w / r + u) and
    ln a = ln c - r (t - u + 1); the sample is the term of least a, together with t. The variates are those of the
    term and sample alone, from bits hashed of both: r (1 - u) and r u are independent exponential variates e and f, so
    r = e + f, a = c exp(-e) exp(-r t) and t = floor((ln w + f) / r), which is 0 for weight 1. There a = c exp(-e) is an
    exponential variate itself, which one number gives: the greatest hash is the least a. Given a, e is ln(1 + g / a)
    with g exponential, so that terms of other weights draw g and f beside it.
    """
    out, least = np.zeros(samples, np.uint16), np.full(samples, np.inf)
    heavy, won = np.ones(samples, bool), np.zeros(samples, np.uint64)
    mul, add = _seed(samples)
    row = np.arange(samples)

    def hashed(mixed: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = mixed[None] * mul
            x += add
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
        return x

    def take(k: np.ndarray, value: np.ndarray, term: np.ndarray, level: np.ndarray, more: bool) -> None:
        with np.errstate(over="ignore"):
            code = (term ^ level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        out[k], least[k], heavy[k], won[k] = (code >> np.uint64(48)).astype(np.uint16), value, more, term

    one = weights == 1
    own, mixed = terms[one], _mix(terms[one])
    top = np.zeros(samples, np.uint64)
    for i in range(0, len(own), block):
        x = hashed(mixed[i : i + block])
        best = x.argmax(axis=1)
        found = x[row, best]
        k = np.flatnonzero(found > top) if i else row
        top[k] = found[k]
        won[k] = own[i + best[k]]
    if len(own):
        take(row, _exponential(top, 64), won.copy(), np.zeros(samples, np.int64), False)
    own, log_w = terms[~one], np.log(weights[~one])
    mixed = _mix(own)
    for i in range(0, len(own), block):
        x = hashed(mixed[i : i + block])
        with np.errstate(over="ignore"):
            y = x * np.uint64(0xA0761D6478BD642F)
            y ^= y >> np.uint64(32)
        value, f = _exponential(x, 64), _exponential(y & np.uint64(0xFFFFFFFF), 32)
        e = np.log1p(_exponential(y >> np.uint64(32), 32) / value)
        r = np.maximum(e + f, 1e-300)
        t = np.floor((log_w[None, i : i + block] + f) / r)
        value *= np.exp(-r * t)
        best = value.argmin(axis=1)
        found = value[row, best]
        k = np.flatnonzero(found < least)
        if len(k):
            take(k, found[k], own[i + best[k]], t[k, best[k]].astype(np.int64), True)
    return least, out, heavy, won


def together(a: Least, b: Least) -> np.ndarray:
    """The signature of two sets without a common term, as one; zeros for the empty set."""
    first = (b[2] < a[2]) | (b[2] == a[2]) & (b[3] < a[3])
    return np.where((b[0] < a[0]) | (b[0] == a[0]) & np.isfinite(b[0]) & first, b[1], a[1])


def signature(terms: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """16 bits for each sample of a weighted set of terms; zeros for the empty set."""
    return least_terms(terms, weights, samples)[1]


Terms = tuple[np.ndarray, np.ndarray]


def weighted_terms(text: bytes, piece: int = 1 << 20) -> Terms:
    """Pairs of neighbouring words with the number of their occurrences; a lone word stands for itself. Words are hashed in
    pieces of a text; of a whole one only the hashes are held.
    """
    raw = np.frombuffer(text, np.uint8)
    words = np.concatenate([np.zeros(0, np.uint64), *[found for _, found, _ in words_by_row(raw, np.array([0, len(raw)]), piece)]])
    if len(words) > 1:
        with np.errstate(over="ignore"):
            words = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + (words[1:] ^ (words[1:] >> np.uint64(31)))
            words ^= words >> np.uint64(29)
    return np.unique(words, return_counts=True)


def two_signatures(a: Terms, b: Terms) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of two weighted sets; terms that both have with one weight are drawn once."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    same = a[1][i] == b[1][j]
    i, j = i[same], j[same]
    common = least_terms(a[0][i], a[1][i])
    rest = [least_terms(np.delete(x[0], k), np.delete(x[1], k)) for x, k in ((a, i), (b, j))]
    return together(common, rest[0]), together(common, rest[1])


def fingerprint(text: str) -> np.ndarray:
    return signature(*weighted_terms(text.encode()))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples: an estimate of sum(min) / sum(max) over the terms' weights."""
    return float((a == b).mean())


def as_text(sign: np.ndarray) -> str:
    return sign.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fingerprint of every document, in one pass. Null text counts as empty, whose fingerprint is zeros; rows
    that repeat have one fingerprint; a very long text holds its word hashes in memory; an empty table gives an empty
    result; other columns are ignored.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([as_text(fingerprint(t.as_py() or "")) for t in b.column(1)], pa.string())], names=[P + "id", "fingerprint"])

    return docs.select(F.col(id_col).alias(P + "id"), F.col(text_col).alias(P + "text")).mapInArrow(run, f"{P}id {kind}, fingerprint string").withColumnRenamed(P + "id", id_col)


#: As they are written: digests and signatures stay binary until the result is read, half the size of their text.
_FIELDS = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _judged(text: str, following: str, own: Terms) -> tuple:
    """Length, digest of the edited text, signature, the edited text's signature and their likeness."""
    cut = len(text) // 4
    edited = (text[: len(text) - cut] + following[:cut]).encode()
    mine, sign = two_signatures(own, weighted_terms(edited))
    return len(text), hashlib.sha256(edited).digest(), mine, sign.astype(">u2").tobytes(), likeness(mine, sign)


def _fields(judged: tuple, following: np.ndarray) -> tuple:
    n, digest, mine, sign, near = judged
    return n, digest, mine.astype(">u2").tobytes(), sign, near, likeness(mine, following)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint beside that of its edited text and that of the next document.

    The order is by id (null first), then a hash of the text; it is made by a range partitioning that splits rows of one
    id and text too, in which each task walks over its rows. A task's last row needs the next task's first: both carry
    their text into a second step, which has one row for each task. Null text counts as empty; rows that repeat follow
    each other. Very long texts are hashed in pieces. An empty table gives an empty result; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType
    id_kind = kind.simpleString()
    order = [P + "id", P + "key", P + "rid"]
    rows = docs.select(F.col(id_col).alias(P + "id"), text_of(text_col).alias(P + "text")).withColumns({P + "key": F.xxhash64(P + "text"), P + "rid": F.monotonically_increasing_id()})
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(P + "id", P + "text", F.spark_partition_id().cast("long").alias(P + "part"))
    names = [P + "id", *[x.split()[0] for x in _FIELDS.split(", ")], P + "part", P + "place", P + "text"]

    def batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        types = [id_type, pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, judged, out, id_type = None, None, [], None
        for b in batches:
            id_type = b.column(0).type
            for me, text, part in zip(*b.columns, strict=True):
                me, text, part = me.as_py(), text.as_py(), part.as_py()
                terms = weighted_terms(text.encode())
                if held is None:
                    out.append((me, None, None, None, None, None, None, part, "first", text))
                else:
                    # A document's signature comes with its edited text's, which needs the next document.
                    now = _judged(held[1], text, held[2])
                    if judged is not None:
                        out.append((judged[0], *_fields(judged[1], now[2]), part, None, None))
                    judged = held[0], now
                held = me, text, terms, part
                if len(out) >= 1000:
                    yield batch(out, id_type)
                    out = []
        if held is not None:
            if judged is not None:
                out.append((judged[0], *_fields(judged[1], signature(*held[2])), held[3], None, None))
            out.append((held[0], None, None, None, None, None, None, held[3], "last", held[1]))
            yield batch(out, id_type)

    walked = written(placed.mapInArrow(walk, f"{P}id {id_kind}, {_FIELDS}, {P}part long, {P}place string, {P}text string"), "fingerprints")
    first = walked.filter(F.col(P + "place") == "first").select(F.col(P + "part").alias(P + "of"), F.col(P + "text").alias(P + "following"))
    last = walked.filter(F.col(P + "place") == "last").select(P + "id", P + "text", P + "part")
    parts = first.select(P + "of")
    after = parts.select(F.col(P + "of").alias(P + "part"), F.coalesce(F.lead(P + "of").over(Window.orderBy(P + "of")), F.min(P + "of").over(Window.partitionBy())).alias(P + "of"))
    pairs = last.join(after, P + "part").join(first, P + "of").select(P + "id", P + "text", P + "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(me.as_py(), *_fields(_judged(t.as_py(), f.as_py(), weighted_terms(t.as_py().encode())), fingerprint(f.as_py())), None, None, None) for me, t, f in zip(*b.columns, strict=True)]
            if out:
                yield batch(out, b.column(0).type).select(names[:-3])

    inner = walked.filter(F.col(P + "place").isNull()).select(*names[:-3])
    out = inner.unionByName(pairs.mapInArrow(close, f"{P}id {id_kind}, {_FIELDS}"))
    hexed = {c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return out.withColumns(hexed).withColumnRenamed(P + "id", id_col)
