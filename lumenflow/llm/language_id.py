"""Language identification with averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import P, runs, utf8

ORDERS = (2, 3, 4)
BITS = 15
UNKNOWN = "und"

#: ASCII letters in lower case, every other ASCII byte a space: digits, marks and blanks tell no language.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def subwords(raw: np.ndarray, order: int) -> np.ndarray:
    """Hashed buckets of all windows of `order` bytes."""
    n = max(len(raw) - order + 1, 0)
    wide = _FOLD[raw].astype(np.uint32)
    key = np.zeros(n, np.uint32)
    for k in range(order):
        key = (key << np.uint32(8)) | wide[k : k + n]
    with np.errstate(over="ignore"):
        key = (key ^ np.uint32(order * 0x45D9F3B)) * np.uint32(0x9E3779B1)
        key ^= key >> np.uint32(15)
        key = key * np.uint32(0x85EBCA77)
    return key >> np.uint32(32 - BITS)


def bag(text: bytes, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of a whole text, their shares, and the number of subwords."""
    raw, total = np.frombuffer(text, np.uint8), np.zeros(1 << BITS, np.int64)
    for at in range(0, len(raw), piece):
        for n in ORDERS:
            total += np.bincount(subwords(raw[at : at + piece + n - 1], n), minlength=1 << BITS)
    found = np.flatnonzero(total)
    return found, total[found] / max(total.sum(), 1), int(total.sum())


def snippets(text: str, draw: int, lengths: tuple[int, ...] = (1, 3, 10)) -> list[str]:
    """A few runs of words at hashed places: examples of short texts, beside the whole text."""
    words = text.split()
    return [" ".join(words[(draw * (k + 7)) % len(words) :][:n]) for k, n in enumerate(lengths) if len(words) > 2 * n]


@dataclass
class Model:
    labels: list[str]
    #: Embedding times softmax weights, a row per bucket: averaging embeddings and then applying
    #: the linear layer is the average of these rows.
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    #: Subwords that a text must have for its average to count half: short texts are less certain.
    shrink: float = 0.0
    min_score: float = 0.5

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def logits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of whole texts; memory is bounded by the number of labels and pieces of texts."""
        out = np.tile(self.bias.astype(np.float64), (len(offsets) - 1, 1))
        piece = max(1 << 14, (1 << 21) // len(self.labels))
        for i, j in runs(offsets, piece):
            total, count = np.zeros((j - i, len(self.labels))), np.zeros(j - i)
            for at in range(offsets[i], offsets[j], piece) if offsets[j] - offsets[i] > piece else [offsets[i]]:
                for n in ORDERS:
                    end = min(at + piece + n - 1, offsets[j]) if j == i + 1 else offsets[j]
                    key = subwords(raw[at:end], n)
                    first = np.clip(offsets[i:j] - at, 0, len(key))
                    last = np.clip(offsets[i + 1 : j + 1] - n + 1 - at, first, len(key))
                    has = last > first
                    if has.any():
                        # One row more, so that the last bound may stand at the end.
                        values = np.concatenate((self.table[key], np.zeros((1, len(self.labels)), self.table.dtype)))
                        total[has] += np.add.reduceat(values, np.stack((first[has], last[has]), 1).ravel(), axis=0)[::2]
                        count[has] += (last - first)[has]
            out[i:j] += total / np.maximum(count + self.shrink, 1)[:, None]
        return out


def fit(bags: list[tuple[np.ndarray, np.ndarray, int]], labels: list[str], held: np.ndarray, dims: int = 16, epochs: int = 12, rate: float = 1.0, seed: int = 7, min_score: float = 0.5) -> Model:
    """Stochastic gradient descent over labelled bags; the `held` ones calibrate temperature and shrinkage."""
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-0.5, 0.5, (1 << BITS, dims)) / dims
    weights, bias = rng.normal(0, 0.5, (dims, len(names))), np.zeros(len(names))
    train, share = np.flatnonzero(~held), np.bincount(y, minlength=len(names)) / max(len(y), 1)
    gain = 1 / np.maximum(share * len(names), 1e-9)  # each language counts alike
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(train):
            key, part, n = bags[i]
            if not n:
                continue
            rows = embed[key]
            mean = part @ rows
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= min(gain[y[i]], 5.0)
            back, power = weights @ p, float((weights * weights).sum()) / len(names)
            # Normalised steps: neither layer's output moves further than the gradient asks.
            weights -= step / (1 + mean @ mean) * np.outer(mean, p)
            bias -= 0.01 * step * p
            # The mean moves by about `step` times the gradient, however few subwords share it.
            embed[key] = rows - step * min(40.0, 0.5 / float(part @ part)) / (1 + power) * np.outer(part, back)
    model = Model(names, (embed @ weights).astype(np.float32), bias.astype(np.float32), min_score=min_score)
    check = np.flatnonzero(held) if held.any() else train
    if len(check):
        mean = np.array([bags[i][1] @ model.table[bags[i][0]] for i in check])
        size = np.array([bags[i][2] for i in check], np.float64)
        best = (np.inf, 1.0, 0.0)
        for shrink in (0.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0):
            logits = model.bias + mean * (size / np.maximum(size + shrink, 1))[:, None]
            for t in np.geomspace(0.1, 20, 60):
                model.temperature = float(t)
                p = model.probabilities(logits)[np.arange(len(check)), y[check]]
                best = min(best, (float(-np.log(np.maximum(p, 1e-12)).mean()), float(t), shrink))
        _, model.temperature, model.shrink = best
    return model


def train_language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None, per_language: int = 400, max_documents: int = 4000, **how) -> Model | None:
    """Fit on a bounded sample of labelled rows: at most `per_language` rows of each language, and about `max_documents`
    in all (one a language at least), chosen by a hash of the row. Every label has a class. Tasks send hashed counts of
    whole texts, at most 2**15 numbers each. None if nothing is labelled.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (learn if learn is not None else F.lit(True)))
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    if not sizes:
        return None
    each = max(1, min(per_language, max_documents // len(sizes)))
    bound = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, 1.25 * each / n + 10 / n))])
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30)).cast("long")
    picked = labelled.select(F.col(lang_col).alias(P + "lang"), F.col(text_col).alias(P + "text"), draw.alias(P + "u")).filter(F.col(P + "u") < bound[F.col(P + "lang")] * F.lit(float(1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text, u in zip(*b.columns, strict=True):
                whole = text.as_py()
                got = [bag(t.encode()) for t in (whole, *snippets(whole, u.as_py()))]
                n = len(got)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang.as_py()] * n), pa.array([u.as_py()] * n), pa.array(range(n), pa.int32()), pa.array([k.astype(np.int32) for k, _, _ in got], pa.list_(pa.int32())), pa.array([p.astype(np.float32) for _, p, _ in got], pa.list_(pa.float32())), pa.array([m for _, _, m in got], pa.int64())],
                    names=["lang", "u", "which", "key", "part", "n"],
                )

    counted = picked.mapInArrow(count, "lang string, u long, which int, key array<int>, part array<float>, n long")
    ranked = counted.withColumn("r", F.dense_rank().over(Window.partitionBy("lang").orderBy("u"))).filter(F.col("r") <= each).drop("r")
    got = ranked.toArrow().combine_chunks()
    order = sorted(range(got.num_rows), key=lambda i: (got["u"][i].as_py(), got["lang"][i].as_py(), got["which"][i].as_py()))
    values = lambda name, kind: [x.values.to_numpy().astype(kind) for x in got[name]]
    keys, parts, langs, sizes = values("key", np.int32), values("part", np.float32), got["lang"].to_pylist(), got["n"].to_pylist()
    draws = got["u"].to_pylist()
    held = np.array([draws[i] % 5 == 0 for i in order])
    bags = [(keys[i], parts[i], sizes[i]) for i in order]
    return fit(bags, [langs[i] for i in order], held, **how)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred, score (calibrated probability) and rejected, under names that begin with `prefix`.

    A text that is null or has no letter is `und` with score 0. A prediction is rejected when its calibrated
    probability is under the model's min_score; `und` is always rejected. Without a model everything is `und`.
    Only the text is looked at, whole: a very long one in pieces of memory. Rows that repeat are judged alike, one by
    one; of languages that tie the first by name is told. An empty table gives an empty result. Columns of docs named
    like the new ones are replaced; give a prefix to keep them.
    """
    import copy

    ship(docs.sparkSession)
    new = [prefix + c for c in ("lang_pred", "score", "rejected")]
    names = [c for c in docs.columns if c not in new]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).alias(P + "text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias(P + "letter"))
    schema = docs.select(*[F.col(f"`{c}`") for c in names]).schema
    out = copy.deepcopy(schema).add(new[0], "string").add(new[1], "double").add(new[2], "boolean")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, ok = b.column(b.num_columns - 2), b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            label, score = np.full(len(text), UNKNOWN, object), np.zeros(len(text))
            if model is not None and ok.any():
                p = model.probabilities(model.logits(*utf8(text)))
                best = p.argmax(axis=1)
                label[ok] = np.array(model.labels, object)[best[ok]]
                score[ok] = p[np.arange(len(p)), best][ok]
            rejected = ~ok | (score < (model.min_score if model else 2))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(label, pa.string()), pa.array(score), pa.array(rejected)], names=[*names, *new])

    return rows.mapInArrow(predict, out)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % 3


def not_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(fold(id_col) != 1, F.lit(False))
