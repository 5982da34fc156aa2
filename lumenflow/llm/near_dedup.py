"""Near-deduplication by order MinHash with verification by banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import P, _mix, text_of, utf8, words_by_row, written

WORDS = 5
SIMILARITY = 0.8
#: A band is ROWS elements, an element the two least k-mers of one hash, in text order. Texts of
#: similarity 0.8 share a band with probability 0.8 ** 4; 24 bands miss one such pair in 300,000.
BANDS, ROWS = 24, 2
#: A shingle with more places in a text than this has them as a mask.
FEW = 16

_rng = np.random.default_rng(2019)
_MUL = ((_rng.integers(0, 1 << 31, BANDS * ROWS, np.uint32) << np.uint32(1)) | np.uint32(1))[:, None]
_ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)[:, None]


def shingles(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """A hash for each k neighbouring words; fewer words are one shingle, no words none."""
    n = max(len(words) - k + 1, min(len(words), 1))
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(k, len(words))):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n].astype(np.uint64) + np.uint64(1)
    return _mix(out)


def occurrences(x: np.ndarray) -> np.ndarray:
    """How often each value has stood before, in text order."""
    order = np.argsort(x, kind="stable")
    first = np.concatenate(([True], x[order][1:] != x[order][:-1]))
    start = np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))
    out = np.empty(len(x), np.int64)
    out[order] = np.arange(len(x)) - start
    return out


def labelled(kmers: np.ndarray) -> np.ndarray:
    """A hash of every k-mer with the number of times it stood before: no two are alike in one text."""
    with np.errstate(over="ignore"):
        return _mix(kmers + occurrences(kmers).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def sketch(kmers: np.ndarray, block: int = 4096) -> np.ndarray:
    """Band hashes of a text: for every hash the two least occurrence-labelled k-mers, kept in text order."""
    with np.errstate(over="ignore"):
        low = (labelled(kmers) >> np.uint64(32)).astype(np.uint32)
        row = np.arange(BANDS * ROWS)
        least, at = np.full((len(row), 2), 1 << 32, np.int64), np.zeros((len(row), 2), np.int64)
        for i in range(0, len(low), block):
            v = low[None, i : i + block] * _MUL
            v += _ADD
            v ^= v >> np.uint32(16)
            v *= np.uint32(0x7FEB352D)
            one = v.argmin(axis=1)
            values, spots = [v[row, one].astype(np.int64)], [one + i]
            if v.shape[1] > 1:
                v[row, one] = np.uint32(0xFFFFFFFF)
                two = v.argmin(axis=1)
                values.append(v[row, two].astype(np.int64))
                spots.append(two + i)
            every = np.concatenate((least, np.stack(values, 1)), 1)
            where = np.concatenate((at, np.stack(spots, 1)), 1)
            best = np.argsort(every, axis=1, kind="stable")[:, :2]
            least, at = np.take_along_axis(every, best, 1), np.take_along_axis(where, best, 1)
        at.sort(axis=1)
        pair = _mix(kmers[at[:, 0]] * np.uint64(0x9E3779B97F4A7C15) + (kmers[at[:, 1]] if len(kmers) > 1 else np.uint64(1)))
        bands = np.zeros(BANDS, np.uint64)
        for r in range(ROWS):
            bands = _mix(bands * np.uint64(0xD6E8FEB86659FD93) + pair[r::ROWS] + np.uint64(r))
        return _mix(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)).view(np.int64)


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Shingles that an alignment in order matches, over all: lcs / (n + m - lcs); 0 if under `least`.

    The alignment is a longest common subsequence in bit-parallel form, a bit for each shingle of a within the band outside
    which no path can reach `least`.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    band = int((1 - least) / (1 + least) * (n + m) + 1e-9)
    if abs(n - m) > band:
        return 0.0
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[n - short + head :][::-1] != b[m - short + head :][::-1])
    tail = int(differ[0]) if len(differ) else short - head
    a, b = a[head : n - tail], b[head : m - tail]
    values, counts = np.unique(a, return_counts=True)
    others, more = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(values, others, assume_unique=True, return_indices=True)
    most = head + tail + int(np.minimum(counts[i], more[j]).sum())
    if most / (n + m - most) < least:
        return 0.0
    common = set(values[i].tolist())
    places: dict[int, list[int]] = {}
    for k, x in enumerate(a.tolist()):
        if x in common:
            places.setdefault(x, []).append(k)
    masks = {x: sum(1 << k for k in p) for x, p in places.items() if len(p) > FEW}
    # The state has a bit for each place of a from `base` to `top`: those below the band stand and are counted, those above
    # it are still untouched.
    base = top = matched = state = 0
    for k, x in enumerate(b.tolist()):
        low, high = max(0, k - band), min(len(a), k + band + 1)
        if high > top:
            state |= ((1 << (high - top)) - 1) << (top - base)
            top = high
        if low - base >= 1024:
            done = min(low, top) - base
            matched += done - (state & ((1 << done) - 1)).bit_count()
            state >>= done
            base += done
        p = places.get(x)
        if p:
            if x in masks:
                hit = masks[x] >> low & ((1 << max(high - low, 0)) - 1)
                hit <<= low - base
            else:
                hit = 0
                for q in p:
                    if low <= q < high:
                        hit |= 1 << (q - base)
            hit &= state
            if hit:
                state = ((state + hit) | (state - hit)) & ((1 << (top - base)) - 1)
    lcs = head + tail + matched + (top - base) - state.bit_count()
    found = lcs / (n + m - lcs)
    return found if found >= least else 0.0


def _sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per document: id, key (md5 of the text), bands, n (shingles), words (32 bits each)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias(P + "id"), F.unhex(F.md5(text_of(text_col))).alias(P + "key"), text_of(text_col).alias(P + "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, raw_offsets = 0, utf8(b.column(2))
            for i, found, counts in words_by_row(*raw_offsets, piece=1 << 21):
                bands, n, words = [], [], []
                small = (found >> np.uint64(32)).astype("<u4")
                ends = np.cumsum(counts)
                for e, c in zip(ends, counts, strict=True):
                    own = small[e - c : e]
                    kmers = shingles(own)
                    bands.append(sketch(kmers) if len(kmers) else None)
                    n.append(len(kmers))
                    words.append(own.tobytes())
                at = i + len(counts)
                yield pa.RecordBatch.from_arrays([*[x.slice(i, at - i) for x in b.columns[:2]], pa.array(bands, pa.list_(pa.int64())), pa.array(n, pa.int64()), pa.array(words, pa.binary())], names=[P + "id", P + "key", P + "bands", P + "n", P + "words"])

    return rows.mapInArrow(run, f"{P}id {kind}, {P}key binary, {P}bands array<long>, {P}n long, {P}words binary")


def _verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts align; the words of both sides are fetched by join."""
    both = pairs.join(words.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a").join(words.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b").select("a", "b", "wa", "wb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [aligned_similarity(*(shingles(np.frombuffer(x.as_py(), "<u4")) for x in pair), least) >= least for pair in zip(*batch.columns[2:], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): the least node that links lead to. Labels spread along links and jump to their label's label,
    so the number of rounds is about the logarithm of the longest path; each round is a written table.
    """
    labels = written(nodes.select("node", F.col("node").alias("label")), "labels")
    two = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    if two.isEmpty():
        return labels
    while True:
        near = two.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("least"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("least", "label")).alias("label"))
        # Whoever pointed at a label that has found a smaller one follows it.
        step = written(step, "step")
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = written(step.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), "labels")
        done = new.filter("label <> old").isEmpty()
        labels = new.select("node", "label")
        if done:
            return labels


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """The sketched documents, and one row per different text: key (md5), least row, winner (the class's least row), class_size.

    1. Each text is sketched once; rows of one text are one node.
    2. In a bucket of a band, every text is tested against a leader, the text that shares most bands with others:
       links grow with the rows of a bucket, not their square.
    3. Texts of one bucket that are still in different classes are tested against each other, so that
       no link between different texts depends on the choice of leader; prefix filtering finds which
       of them can be similar at all.
    """
    sigs = written(_sketches(docs, id_col, text_col).withColumn(P + "rid", F.monotonically_increasing_id()), "sketches")
    texts = sigs.groupBy(P + "key", P + "bands", P + "n").agg(F.min(F.struct(F.col(P + "id").isNull().alias("none"), F.col(P + "id").alias("id"), F.col(P + "rid").alias("rid"))).alias("least"), F.count("*").alias("rows"))
    texts = written(texts.withColumn("node", F.monotonically_increasing_id()), "texts")

    member = texts.filter(F.col(P + "bands").isNotNull()).select("node", F.col(P + "n").alias("n"), F.explode(P + "bands").alias("bucket"))
    crowded = member.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    member = written(member.join(crowded, "bucket"), "members")
    score = member.groupBy("node").agg(F.sum("size").alias("score"))
    scored = member.join(score, "node")
    leader = scored.groupBy("bucket").agg(F.max(F.struct("score", -F.col("node"), "n")).alias("l")).select("bucket", (-F.col("l")["col2"]).alias("b"), F.col("l")["n"].alias("bn"))
    fits = lambda x, y: F.least(x, y) >= F.greatest(x, y) * similarity  # noqa: E731  a necessary condition
    tried = member.join(leader, "bucket").filter((F.col("node") != F.col("b")) & fits(F.col("n"), F.col("bn")))
    tried = written(tried.select(F.col("node").alias("a"), "b").distinct(), "tried")

    chosen = texts.join(member.select("node").distinct(), "node").select("node", F.col("least")["rid"].alias(P + "rid"))
    words = written(sigs.select(P + "rid", F.col(P + "words").alias("words")).join(chosen, P + "rid").select("node", "words"), "words")
    links = written(_verified(tried, words, similarity), "verified")
    nodes = member.select("node").distinct()
    labels = components(links, nodes)

    placed = member.join(labels, "node")
    split = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
    open_ = written(placed.join(split, "bucket").select("node", "n", "label").distinct(), "open")
    if not open_.isEmpty():
        rest = _prefix_pairs(open_, words, similarity)
        seen = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = written(_verified(rest.join(seen, ["a", "b"], "left_anti"), words, similarity), "verified")
        if not more.isEmpty():
            labels = components(links.unionByName(more), nodes)

    out = texts.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = out.groupBy("label").agg(F.min("least").alias("winner"), F.sum("rows").alias("class_size"))
    return sigs, written(out.select(P + "key", "least", "label").join(classes, "label").select(P + "key", "least", "winner", "class_size"), "classes")


def _prefix_pairs(texts: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Pairs (a < b) of texts (node, n, label) with different labels that may reach `least`, by prefix filtering.

    A text's occurrence-labelled shingles stand in order of how many of these texts have them, rarest first. Two texts
    that reach `least` have a common shingle among the first n - least * n + 1 of each, so early that what follows
    can still make up the overlap they need. Shingles of one text alone come first and need no row: a text whose prefix
    they fill has no partner, which keeps groups of loosely similar texts from yielding their pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, own in zip(b.column(0), b.column(1), strict=True):
                kmers = shingles(np.frombuffer(own.as_py(), "<u4"))
                found = labelled(kmers).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), node.as_py())), pa.array(found)], names=["node", "shingle"])

    each = written(texts.join(words, "node").select("node", "words").mapInArrow(run, "node long, shingle long"), "shingles")
    common = each.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = each.join(common, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("s"))
    alone = F.col("n") - F.size("s")
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1
    first = texts.join(ranked, "node").filter(alone < prefix).select("node", "n", "label", alone.alias("alone"), F.posexplode(F.slice("s", F.lit(1), (prefix - alone).cast("int"))).alias("k", "s"))
    first = written(first.select("node", "n", "label", (F.col("alone") + F.col("k") + 1).alias("at"), F.col("s")["shingle"].alias("shingle")), "prefixes")
    x, y = first.alias("x"), first.alias("y")
    reach = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) + 1
    need = (F.col("x.n") + F.col("y.n")) * F.lit(least / (1 + least)) - 1e-9
    pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & (reach >= need))
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row per document: id_col, class_id (least id of the class), class_size and kept.

    Similarity is over five-word shingles, matched in order: lcs / union. Null text counts as empty; empty texts are one
    class; texts under five words are one shingle. Null ids never stand for a class unless it has no other. Of rows
    that repeat one id and text, one is kept; of ties the least id stands for a class. Very long texts are sketched and
    aligned whole. An empty table gives an empty result; other columns are ignored.
    """
    sigs, classes = near_classes(docs, id_col, text_col, similarity)
    rows = sigs.select(P + "id", P + "key", P + "rid").join(classes.select(P + "key", "winner", "class_size"), P + "key")
    return rows.select(F.col(P + "id").alias(id_col), F.col("winner")["id"].alias("class_id"), "class_size", (F.col("winner")["rid"] == F.col(P + "rid")).alias("kept"))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, with the columns of docs."""
    _, classes = near_classes(docs, id_col, text_col, similarity)
    best = classes.filter(F.col("least") == F.col("winner")).select(P + "key", F.col("winner")["id"].alias(P + "least"), F.xxhash64(F.col("winner")["id"]).alias(P + "pick"))
    # Joined on text and id, copies of one text are dealt over many tasks.
    rows = docs.withColumns({P + "key": F.unhex(F.md5(text_of(text_col))), P + "pick": F.xxhash64(F.col(id_col))})
    rows = rows.join(best, [P + "key", P + "pick"]).filter(F.col(id_col).eqNullSafe(F.col(P + "least")))
    first = F.row_number().over(Window.partitionBy(P + "key", P + "pick").orderBy(F.lit(1)))
    return rows.withColumn(P + "first", first).filter(F.col(P + "first") == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
