"""Masked pseudo-likelihood scores from a bidirectional window network with a memory of spans."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, _mix, _powers, utf8, words_by_row, written

HEAD = 1 << 18  # at most so many words, the commonest, are known in every task; the others' counts are joined
OWN = 448  # at least so many of the commonest words have vectors of their own, or as many as the root of the number of words
REST = 16  # classes of the words without vectors of their own; the last is that of words outside the head
DIMS = 16
REACH = 2
BATCH = 8192
UNIT = 1 << 20  # words that one unit of training has, about
RATE = 0.05
BOUND = 4.0  # of every output weight
#: Words that a remembered span has on average, and the weight of the network beside what is remembered.
SPAN, TRUST = 8, 1.0
SLICES = 16
SCALE = 1 << 20


@dataclass
class Counts:
    """The written table of all words, h (hash) and n (occurrences), and how many words have each n."""

    table: DataFrame
    n: np.ndarray
    words: np.ndarray

    def sum(self) -> int:
        return int((self.n * self.words).sum())


def find(words: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Positions in the sorted words; their number for those that are not there."""
    if not len(words):
        return np.zeros(np.shape(key), np.int64)
    at = np.minimum(np.searchsorted(words, key), len(words) - 1)
    return np.where(words[at] == key, at, len(words))


@dataclass
class Vocabulary:
    """What the counts of all words of the corpus give. Arrays by head word end with a value for all words outside the head.

    The `own` commonest words have an input and an output vector each. In falling order of their counts they form
    classes of like shares of all occurrences; class g holds ranks ends[g] to ends[g + 1]. The other words of the head
    form classes in the same way, without vectors: log P(word | class) of theirs is `inside`, a share of counts. Words
    outside the head are the last class; `tail` is the table of their shares.
    """

    words: np.ndarray
    klass: np.ndarray
    rank: np.ndarray
    inside: np.ndarray
    input: np.ndarray
    ends: np.ndarray
    #: Log shares of the classes, and of the own words in their classes: where the network's biases start.
    prior: np.ndarray
    within: np.ndarray
    total: int
    tail: DataFrame | None = None

    def __getstate__(self):
        return {**self.__dict__, "tail": None}

    @property
    def own(self) -> int:
        return int(self.ends[-1])

    @property
    def classes(self) -> int:
        return len(self.prior)

    def shapes(self) -> dict[str, tuple]:
        return {"E": (1 + self.own + self.classes, DIMS), "c": (2 * REACH, DIMS), "b": (DIMS,), "A": (DIMS, self.classes), "a": (self.classes,), "B": (self.own, DIMS), "d": (self.own,)}


def _bands(n: np.ndarray, most: int) -> np.ndarray:
    """Ends of at most `most` runs of like mass, over counts in falling order; none is empty."""
    if not len(n):
        return np.zeros(1, np.int64)
    mass = np.cumsum(n, dtype=np.float64)
    band = np.minimum((mass - n / 2) / mass[-1] * most, most - 1).astype(np.int64)
    return np.append(np.flatnonzero(np.diff(band, prepend=-1)), len(n))


def vocabulary(counts: Counts, most: int = HEAD, own: int | None = None) -> Vocabulary:
    """The head is all words of at least so many occurrences that `most` words are not exceeded. The number of own
    vectors grows with the root of the number of words, and that of classes with the root of theirs.
    """
    order = np.argsort(-counts.n)
    fits = np.cumsum(counts.words[order]) <= most
    least = int(counts.n[order][fits].min()) if fits.any() else int(counts.n.max(initial=0)) + 1
    got = counts.table.filter(F.col("n") >= least).toArrow()
    words, n = got.column("h").to_numpy().astype(np.int64).view(np.uint64), got.column("n").to_numpy().astype(np.int64)
    place = np.argsort(words)
    words, n = words[place], n[place]
    order = np.argsort(-n, kind="stable")
    own = min(own or max(OWN, math.isqrt(int(counts.words.sum()))), len(words))
    ends = _bands(n[order[:own]], max(1, math.isqrt(own)))
    rest = _bands(n[order[own:]], REST - 1)
    groups = len(ends) - 1 + len(rest) - 1
    klass, rank = np.full(len(words) + 1, groups, np.int32), np.full(len(words) + 1, own, np.int32)
    klass[order] = np.searchsorted(np.concatenate((ends[:-1], own + rest[:-1])), np.arange(len(words)), "right") - 1
    rank[order[:own]] = np.arange(own)
    smooth = n + 0.5
    share = np.bincount(klass[:-1], smooth, groups + 1)
    share_in = np.log(smooth / share[klass[:-1]]) if len(words) else np.zeros(0)
    within = share_in[order[:own]].astype(np.float32)
    beyond = float(((counts.n + 0.5) * counts.words)[counts.n < least].sum())
    share[-1] += beyond
    inside = np.append(np.where(rank[:-1] < own, 0, share_in), 0).astype(np.float32)
    vector = np.where(rank < own, 1 + rank, 1 + own + klass).astype(np.int32)
    tail = counts.table.filter(F.col("n") < least).select("h", F.log((F.col("n") + 0.5) / F.lit(beyond)).alias("inside")) if beyond else None
    prior = np.log(np.maximum(share, 0.5) / max(share.sum(), 0.5)).astype(np.float32)
    return Vocabulary(words, klass, rank, inside, vector, ends, prior, within, counts.sum(), tail)


Net = dict[str, np.ndarray]


def initial(voc: Vocabulary, seed: int = 11) -> Net:
    """Before any training: small weights, and shares of counts whatever stands around."""
    rng = np.random.default_rng(seed)
    net = {k: rng.normal(0, 0.1, s).astype(np.float32) if len(s) > 1 else np.zeros(s, np.float32) for k, s in voc.shapes().items()}
    net["c"] += 1
    return net | {"a": voc.prior.copy(), "d": voc.within.copy()}


def _padded(found: np.ndarray, counts: np.ndarray, fill) -> tuple[np.ndarray, np.ndarray]:
    """Values with REACH fillers on either side of every row, and the places of the values."""
    row = np.repeat(np.arange(len(counts)), counts)
    out = np.full(len(found) + 2 * REACH * len(counts), fill, found.dtype)
    at = np.arange(len(found)) + REACH + 2 * REACH * row
    out[at] = found
    return out, at


OFFSETS = (*range(-REACH, 0), *range(1, REACH + 1))


def _shifted(x: np.ndarray, n: int) -> list[np.ndarray]:
    """Views of x at each offset from places REACH to REACH + n."""
    return [x[REACH + o : REACH + o + n] for o in OFFSETS]


def _hidden(net: Net, around: np.ndarray) -> np.ndarray:
    """What stands on both sides of every place but the first and last REACH; the word there is masked."""
    n = len(around) - 2 * REACH
    h = np.repeat(net["b"][None], n, axis=0)
    for k, side in enumerate(_shifted(around, n)):
        h += side * net["c"][k]
    return np.tanh(h, out=h)


def _softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(z) and its sums by row; BOUND keeps z where exp is finite."""
    e = np.exp(z)
    return e, e @ np.ones(z.shape[1], np.float32)


def _members(voc: Vocabulary, klass: np.ndarray):
    """For each class of own words that occurs: the range of its ranks and the rows of its words."""
    order = np.argsort(klass.astype(np.int16) if voc.classes < 1 << 15 else klass, kind="stable")
    cuts = np.searchsorted(klass[order], np.arange(len(voc.ends)))
    for g in np.flatnonzero(np.diff(cuts)):
        if voc.ends[g + 1] - voc.ends[g] > 1:
            yield int(voc.ends[g]), int(voc.ends[g + 1]), order[cuts[g] : cuts[g + 1]]


def log_probabilities(net: Net, voc: Vocabulary, found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every word: log P(word | both sides) by the network, and its position in the head; of words outside the head log P(class | both sides)."""
    known = find(voc.words, found)
    x, at = _padded(voc.input[known], counts, 0)
    klass, rank, each = voc.klass[known], voc.rank[known], voc.inside[known].astype(np.float64)
    for i in range(0, len(at), BATCH):
        j = slice(i, i + BATCH)
        low = int(at[j][0]) - REACH
        h = _hidden(net, net["E"][x[low : int(at[j][-1]) + REACH + 1]])[at[j] - REACH - low]
        z = h @ net["A"] + net["a"]
        each[j] += z[np.arange(len(h)), klass[j]] - np.log(_softmax(z)[1])
        for s, e, rows in _members(voc, klass[j]):
            z = h[rows] @ net["B"][s:e].T + net["d"][s:e]
            each[i + rows] += z[np.arange(len(rows)), rank[j][rows] - s] - np.log(_softmax(z)[1])
    return each, known


class Learner:
    """Gradient descent on one unit of documents, with step sizes of every weight's own (Adagrad)."""

    def __init__(self, net: Net, voc: Vocabulary, rate: float = RATE):
        self.net, self.voc, self.rate, self.seen = {k: v.copy() for k, v in net.items()}, voc, rate, 0
        self.past = {k: np.full_like(v, 0.1) for k, v in net.items()}

    def _step(self, name: str, where, grad: np.ndarray) -> None:
        past = self.past[name][where] + grad * grad
        self.past[name][where] = past
        new = self.net[name][where] - self.rate * grad / np.sqrt(past)
        self.net[name][where] = np.clip(new, -BOUND, BOUND) if name in "AB" else new

    def learn(self, found: np.ndarray, counts: np.ndarray) -> None:
        known = find(self.voc.words, found)
        x, at = _padded(self.voc.input[known], counts, 0)
        klass, rank, i = self.voc.klass[known], self.voc.rank[known], 0
        while i < len(at):
            j = slice(i, i + min(BATCH, 256 + self.seen // 16))
            self._batch(x, at[j], klass[j], rank[j])
            self.seen += len(at[j])
            i = j.stop

    def _batch(self, x: np.ndarray, at: np.ndarray, klass: np.ndarray, rank: np.ndarray) -> None:
        net, low = self.net, int(at[0]) - REACH
        inputs = x[low : int(at[-1]) + REACH + 1]
        around, at = net["E"][inputs], at - REACH - low
        every = _hidden(net, around)
        h = every[at]
        d, total = _softmax(h @ net["A"] + net["a"])
        d *= (1 / total)[:, None]
        d[np.arange(len(h)), klass] -= 1
        back = d @ net["A"].T
        for s, e, rows in _members(self.voc, klass):
            own = h[rows]
            q, total = _softmax(own @ net["B"][s:e].T + net["d"][s:e])
            q *= (1 / total)[:, None]
            q[np.arange(len(rows)), rank[rows] - s] -= 1
            back[rows] += q @ net["B"][s:e]
            self._step("B", slice(s, e), q.T @ own)
            self._step("d", slice(s, e), q.sum(axis=0))
        self._step("A", ..., h.T @ d)
        self._step("a", ..., d.sum(axis=0))
        back *= 1 - h * h
        self._step("b", ..., back.sum(axis=0))
        # A place's input gets what every neighbour sends it; then the places of one input are added up.
        spread = np.zeros_like(every)
        spread[at] = back
        sent, grad_c, part, ones = np.zeros_like(around), np.empty_like(net["c"]), np.empty_like(spread), np.ones(len(spread), np.float32)
        for k, (from_, to) in enumerate(zip(_shifted(around, len(spread)), _shifted(sent, len(spread)), strict=True)):
            np.multiply(spread, from_, out=part)
            grad_c[k] = ones @ part
            np.multiply(spread, net["c"][k], out=part)
            to += part
        order = np.argsort(inputs.astype(np.int16) if len(net["E"]) < 1 << 15 else inputs, kind="stable")
        first = np.flatnonzero(np.diff(inputs[order], prepend=-1))
        self._step("E", inputs[order[first]], np.add.reduceat(sent[order], first, axis=0))
        self._step("c", ..., grad_c)


def corpus_counts(docs: DataFrame, text_col: str = "text") -> Counts:
    """Occurrences of every word of all documents, in a written table; the driver gets one row for each different count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

        for b in batches:
            for _, found, _ in words_by_row(*utf8(b.column(0))):
                held.append(found)
                size += len(found)
                if size > 2_000_000:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    rows = docs.select(F.col(text_col).alias(P + "text")).mapInArrow(count, "h long, n long")
    table = written(rows.groupBy("h").agg(F.sum("n").alias("n")), "words")
    got = table.groupBy("n").agg(F.count("*").alias("words")).toArrow()
    return Counts(table, got.column("n").to_numpy().astype(np.int64), got.column("words").to_numpy().astype(np.int64))


def _summed(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of equal keys added up; `v` holds whole numbers as bytes. One sum is held for each key."""
    held: dict[tuple, list] = {}
    for b in batches:
        for *key, weight, v in zip(*[b.column(c) for c in (*keys, "w", "v")], strict=True):
            own = held.setdefault(tuple(k.as_py() for k in key), [0, 0])
            own[0] += weight.as_py()
            own[1] = own[1] + np.frombuffer(v.as_buffer(), np.int64)
    for key, (weight, v) in held.items():
        yield pa.RecordBatch.from_arrays([*[pa.array([k], pa.int32()) for k in key], pa.array([weight], pa.int64()), pa.array([v.tobytes()])], names=[*keys, "w", "v"])


def train(docs: DataFrame, voc: Vocabulary, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, unit: int = UNIT) -> Net:
    """Parameter mixing: each unit of documents, chosen by a hash of id and text, descends over all of its words from a
    common start, and the weights are averaged by the number of words learnt from. All documents take part.

    Units are the same however the rows are dealt to tasks, and averages are of whole numbers, so the result depends
    neither on partitions nor on the order in which tasks end. A task adds up its units' weights; sums of slices of
    them are added by 64 tasks, then by one for each slice. The driver gets one net.
    """
    units = max(1, -(-voc.total // unit))
    net, shapes = initial(voc), voc.shapes()
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.pmod(key, F.lit(units)).cast("int").alias("unit"), key.alias("key"), F.col(text_col).alias("text"))
    dealt = rows.repartition("unit").sortWithinPartitions("unit", "key")

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if own is not None and own.seen:
                weight = 1 + (own.seen >> 10)
                flat = np.round(np.concatenate([own.net[k].ravel() for k in shapes]).astype(np.float64) * SCALE).astype(np.int64) * weight
                for s, v in enumerate(np.array_split(flat, SLICES)):
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([at % 64], pa.int32()), pa.array([weight], pa.int64()), pa.array([v.tobytes()])], names=["slice", "part", "w", "v"])

        for b in batches:
            unit_of = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(unit_of)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if unit_of[i] != at:
                    yield from done()
                    at, own = int(unit_of[i]), Learner(net, voc, rate)
                for _, found, counts in words_by_row(*utf8(b.column(2).slice(i, j - i))):
                    if len(found):
                        own.learn(found, counts)
        yield from done()

    sums = dealt.mapInArrow(lambda bs: _summed(descend(bs), ["slice", "part"]), "slice int, part int, w long, v binary")
    if units > 64:
        sums = sums.repartition("part").mapInArrow(lambda bs: _summed(bs, ["slice", "part"]), "slice int, part int, w long, v binary")
    sums = sums.repartition("slice").mapInArrow(lambda bs: _summed(bs, ["slice"]), "slice int, w long, v binary").orderBy("slice").toArrow()
    if not sums.num_rows:
        return net
    flat = np.concatenate([np.frombuffer(v.as_buffer(), np.int64) / (w.as_py() * SCALE) for w, v in zip(sums.column("w"), sums.column("v"), strict=True)]).astype(np.float32)
    sizes = [int(np.prod(s)) for s in shapes.values()]
    return {k: x.reshape(s) for (k, s), x in zip(shapes.items(), np.split(flat, np.cumsum(sizes)[:-1]), strict=True)}


def spans(found: np.ndarray, counts: np.ndarray, size: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (exclusive), hashes of the words and hashes of what stands on both sides, of the spans that every text
    falls into: a span ends with each word whose hash is divisible by `size`, and with the text.
    """
    ends = np.cumsum(counts)
    last = _mix(found) % np.uint64(size) == 0
    last[ends[counts > 0] - 1] = True
    end = np.flatnonzero(last) + 1
    start = np.concatenate((np.zeros(min(1, len(end)), np.int64), end[:-1]))
    up, down = _powers(max(len(found), 1))
    padded, at = _padded(found, counts, np.uint64(0))
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(found * up[: len(found)], dtype=np.uint64)))
        code = _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
        around = np.zeros(len(start), np.uint64)
        for k in range(1, REACH + 1):
            around = around * np.uint64(0x9E3779B97F4A7C15) + _mix(padded[at[start] - k] + np.uint64(1))
            around = around * np.uint64(0x9E3779B97F4A7C15) + _mix(padded[at[end - 1] + k] + np.uint64(2))
    return start, end, code, _mix(around)


DOCUMENT, TAIL, REMEMBERED = 0, 1, 2


def score(docs: DataFrame, net: Net, voc: Vocabulary, id_col: str = "doc_id", text_col: str = "text", memory: bool = True) -> DataFrame:
    """A row per document: id_col, n_words, log_prob (natural, summed), log_prob_per_word (null without words).

    The network gives every word's probability from both sides. Texts fall into spans of SPAN words on average; where the
    rest of the corpus has something between the same REACH words (or ends of the text) on both sides, a span as a whole
    has (n + TRUST q) / (N + TRUST), with q the product of its words' probabilities, N the other occurrences of the two
    sides and n those with this span between them. As the occurrence that is scored is left out, a text that stands
    once gains nothing from itself; words that the corpus repeats are expected.

    Null text counts as empty: no words, sum 0. Rows that repeat score alike. A text of any length is scored in pieces
    of memory; an empty table gives an empty result; columns other than id and text are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [P + x for x in ("id", "key", "kind", "a", "b", "k", "v", "rare")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, words = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)

            def out(row: np.ndarray, of: int, *values, b=b) -> pa.RecordBatch:
                at = pa.array(row)
                values = [pa.array(v, k) if v is not None else pa.nulls(len(row), k) for v, k in zip(values, types, strict=True)]
                return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(np.full(len(row), of, np.int8)), *values], names=names)

            for i, found, counts in words_by_row(*utf8(b.column(1))):
                each, known = log_probabilities(net, voc, found, counts)
                row = np.repeat(np.arange(i, i + len(counts)), counts)
                words[i : i + len(counts)] = counts
                ends = np.concatenate(([0], np.cumsum(counts)))
                sums = np.concatenate(([0.0], np.cumsum(each)))
                total[i : i + len(counts)] = sums[ends[1:]] - sums[ends[:-1]]
                beyond = known == len(voc.words)
                if beyond.any():
                    first, times = _distinct(row[beyond], found[beyond])
                    yield out(row[beyond][first], TAIL, found[beyond][first].view(np.int64), None, times, None, None)
                if memory and len(found):
                    start, end, code, around = spans(found, counts)
                    first, times = _distinct(row[start], around, code)
                    start, end = start[first], end[first]
                    cuts = np.concatenate(([0], np.cumsum(beyond)))
                    rare, many = found[beyond].view(np.int64), cuts[end] - cuts[start]
                    of = np.repeat(cuts[start] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32)), pa.array(rare[of]))
                    yield out(row[start], REMEMBERED, around[first].view(np.int64), code[first].view(np.int64), times, sums[end] - sums[start], lists)
            yield out(np.arange(b.num_rows), DOCUMENT, None, None, words, total, None)

    rows = docs.select(F.col(id_col).alias(P + "id"), F.col(text_col).alias(P + "text"), F.xxhash64(text_col).alias(P + "key"))
    parts = written(rows.mapInArrow(run, f"{P}id {kind}, {P}key long, {P}kind tinyint, {P}a long, {P}b long, {P}k long, {P}v double, {P}rare array<long>"), "scores", P + "kind")
    out = parts.filter(F.col(P + "kind") == DOCUMENT).select(P + "id", P + "key", F.col(P + "k").alias("n_words"), F.col(P + "v").alias(P + "sum"))
    more = []
    if voc.tail is not None:
        more.append(_tail_terms(parts.filter(F.col(P + "kind") == TAIL), voc))
    if memory:
        more.append(_memory_terms(parts.filter(F.col(P + "kind") == REMEMBERED), voc))
    total = F.col(P + "sum")
    if more:
        each = more[0] if len(more) == 1 else more[0].unionByName(more[1])
        rest = each.groupBy(P + "id", P + "key").agg((F.sum(F.round(F.col("term") * (1 << 30)).cast("long")) / (1 << 30)).alias(P + "rest"))
        rest = rest.withColumnRenamed(P + "id", P + "id2").withColumnRenamed(P + "key", P + "key2")
        out = out.join(rest, out[P + "id"].eqNullSafe(rest[P + "id2"]) & (out[P + "key"] == rest[P + "key2"]), "left")
        total = total + F.coalesce(F.col(P + "rest"), F.lit(0.0))
    per_word = F.when(F.col("n_words") > 0, total / F.col("n_words"))
    return out.select(F.col(P + "id").alias(id_col), "n_words", total.alias("log_prob"), per_word.alias("log_prob_per_word"))


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the different rows of keys, and how often each stands."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def _tail_terms(rows: DataFrame, voc: Vocabulary) -> DataFrame:
    """log P(word | class) of each text's words outside the head. Rows of one id and text are one."""
    each = rows.groupBy(P + "id", P + "key", F.col(P + "a").alias("h")).agg(F.max(P + "k").alias("k"))
    return each.join(voc.tail, "h").select(P + "id", P + "key", (F.col("inside") * F.col("k")).alias("term"))


def _memory_terms(rows: DataFrame, voc: Vocabulary) -> DataFrame:
    """What remembered spans add to log P. Only sides that stand more than once go further than a count."""
    each = rows.select(P + "id", P + "key", F.col(P + "a").alias("c"), F.col(P + "b").alias("s"), F.col(P + "k").alias("k"), F.col(P + "v").alias("v"), F.col(P + "rare").alias("rare"))
    sides = written(each.groupBy("c").agg(F.sum("k").alias("all")).filter("all > 1"), "sides")
    again = written(each.join(sides, "c"), "again")
    # One row for each different span; all that its rows hold beside the document is the same.
    found = written(again.groupBy("c", "s").agg(F.sum("k").alias("n"), F.max("all").alias("all"), F.max("v").alias("v"), F.first("rare").alias("rare")), "spans")
    total = F.col("v")
    if voc.tail is not None:
        of_rare = found.filter("n > 1").select("c", "s", F.explode("rare").alias("h")).join(voc.tail, "h").groupBy("c", "s").agg(F.sum("inside").alias("beyond"))
        found = found.drop("rare").join(of_rare, ["c", "s"], "left")
        total = total + F.coalesce("beyond", F.lit(0.0))
    share = F.log((F.col("n") - 1 + F.lit(TRUST) * F.exp(total)) / (F.col("all") - 1 + F.lit(TRUST))) - total
    alone = F.log(F.lit(TRUST) / (F.col("all") - 1 + F.lit(TRUST)))
    terms = found.select("c", "s", F.when(F.col("n") > 1, share).otherwise(alone).alias("each"))
    joined = again.select(P + "id", P + "key", "c", "s", "k").join(terms, ["c", "s"])
    return joined.groupBy(P + "id", P + "key", "c", "s").agg((F.max("k") * F.max("each")).alias("term")).select(P + "id", P + "key", "term")


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: bool = True, **how) -> DataFrame:
    """Counts, network and scores, each over all documents; see `score` for its rows and awkward cases."""
    voc = vocabulary(corpus_counts(docs, text_col))
    return score(docs, train(docs, voc, id_col, text_col, **how), voc, id_col, text_col, memory)
