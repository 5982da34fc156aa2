"""Packing tokenized documents into windows by minimum bin slack."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P

WINDOW = 2048
#: Tokens that one packing block holds at most, besides one document: bounds a task's memory.
BLOCK_TOKENS = 8_000_000

LONG_RUN = 2000

_encoders: dict[str, Callable] = {}


def encoder(path: str) -> Callable[[str], list[int]]:
    """Ids as tokenizers gives them by default, without added special tokens; strings of special tokens that stand in a
    text have the tokens' ids. Ranks are the vocabulary's, so tiktoken gives the same ids several times faster; texts
    that may hold a pre-token of LONG_RUN characters, and those with a special token's string, go to tokenizers
    itself, whose merge is not quadratic.
    """
    if path in _encoders:
        return _encoders[path]
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(visible))}
    special = sorted({t["content"] for t in spec["added_tokens"]})
    ranks = {bytes(letters[c] for c in word): k for word, k in spec["model"]["vocab"].items() if word not in special}
    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(x in text for x in special):
            return slow.encode(text, add_special_tokens=False).ids
        if len(text) >= LONG_RUN:
            words = text.split()
            blanks = len(text) - sum(map(len, words))
            if max(map(len, words), default=0) >= LONG_RUN or blanks - len(words) >= LONG_RUN - 1:
                return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    _encoders[path] = encode
    return encode


def fill(counts: list[int], room: int) -> dict[int, int]:
    """The multiset of lengths (count by length) whose sum is nearest to `room` from below.

    Subset-sum over a bitset: bit s is set if some multiset seen so far sums to s. Lengths enter in
    falling order, each with its count split in powers of two; the walk back reads off the counts. It
    stops as soon as `room` itself can be reached.
    """
    reach, full = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for length in range(min(room, len(counts) - 1), 0, -1):
        left = min(counts[length], room // length)
        step = 1
        while left > 0:
            take = min(step, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            step *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= length * take
    return out


def plan(counts: list[int], window: int = WINDOW) -> Iterator[list[tuple[str, int]]]:
    """Bins as lists of (action, length): "whole" takes a piece of that length; "cut" takes the first part
    of the longest piece that remains, whose rest is dealt again. A bin is cut full only if no multiset fills it.
    """
    left = sum(k * n for k, n in enumerate(counts))
    longest = len(counts) - 1
    while left:
        while not counts[longest]:
            longest -= 1
        counts[longest] -= 1
        chosen = fill(counts, window - longest)
        bin_ = [("whole", longest)]
        used = longest
        for length, n in sorted(chosen.items(), reverse=True):
            counts[length] -= n
            used += length * n
            bin_ += [("whole", length)] * n
        left -= used
        if used < window and left:
            while not counts[longest]:
                longest -= 1
            # Every piece that remains is longer than the slack, or the slack would have taken it.
            counts[longest] -= 1
            counts[longest - (window - used)] += 1
            bin_.append((f"cut {longest}", window - used))
            left -= window - used
        yield bin_


def pack_block(lengths: np.ndarray, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of these token counts.

    Full windows are cut from the front of a long document; what remains is packed. Tokens of the last,
    unfilled bin are cut into sequences whose lengths are powers of two, which need no padding.
    """
    sequence = 0
    pools: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]
    for d, n in enumerate(lengths.tolist()):
        for k in range(n // window):
            yield d, k * window, window, sequence, 0
            sequence += 1
        if n % window:
            pools[n % window].append((d, n - n % window))
    for p in pools:
        p.reverse()
    bins = plan([len(p) for p in pools], window)
    for bin_ in bins:
        pieces = []
        for action, length in bin_:
            if action == "whole":
                pieces.append((*pools[length].pop(), length))
            else:
                whole = int(action[4:])
                d, start = pools[whole].pop()
                pieces.append((d, start, length))
                pools[whole - length].append((d, start + length))
        used = sum(n for _, _, n in pieces)
        if used == window:
            at = 0
            for d, start, n in pieces:
                yield d, start, n, sequence, at
                at += n
            sequence += 1
            continue
        room = at = 0
        for d, start, n in pieces:
            while n:
                if not room:
                    room, at = 1 << (used.bit_length() - 1), 0
                    used -= room
                    sequence += 1
                take = min(n, room)
                yield d, start, take, sequence - 1, at
                start, n, room, at = start + take, n - take, room - take, at + take


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, vocabulary: str | None = None, end_id: int = 1, digest: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most `window` tokens: id_col, start, length, ids, doc_tokens,
    sequence_id, offset; with digest=True ids_crc32 instead of ids.

    Each task packs the documents that it reads, in blocks of bounded size, so nothing is shuffled and no
    global count is needed. A window starts with the longest remaining piece; bitset subset-sum dynamic programming
    over the histogram of remaining lengths picks what fills the rest closest to capacity.
    sequence_id is the task's number times 2**40 plus a count; a task that is run again gives the same
    rows. Null or empty text is its end id alone; rows that repeat are packed once each; a null id stays
    null; an empty table gives an empty result; other columns are ignored.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias(P + "id"), F.col(text_col).alias(P + "text"), F.spark_partition_id().alias(P + "part"))
    value = "ids_crc32 long" if digest else "ids array<int>"
    schema = f"{P}id {kind.simpleString()}, start long, length long, {value}, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        encode = encoder(vocabulary)
        ids: list = []
        tokens: list[np.ndarray] = []
        held, base = 0, 0
        part = None

        def flush():
            nonlocal base, held
            got = [list(x) for x in zip(*pack_block(np.array([len(t) for t in tokens], np.int64), window), strict=True)]
            d, start, length, seq, at = got
            if digest:
                out = pa.array([zlib.crc32(tokens[i][s : s + n]) for i, s, n in zip(d, start, length, strict=True)], pa.int64())
            else:
                out = pa.array([tokens[i][s : s + n].astype(np.int32) for i, s, n in zip(d, start, length, strict=True)], pa.list_(pa.int32()))
            size = np.array([len(t) for t in tokens], np.int64)[np.array(d)]
            yield from pa.Table.from_arrays(
                [pa.array([ids[i] for i in d], id_type), pa.array(start, pa.int64()), pa.array(length, pa.int64()), out, pa.array(size), pa.array(np.array(seq, np.int64) + base + (part << 40)), pa.array(at, pa.int64())],
                names=[P + "id", "start", "length", value.split()[0], "doc_tokens", "sequence_id", "offset"],
            ).to_batches(max_chunksize=20_000)
            base += max(seq) + 1
            held = 0
            ids.clear()
            tokens.clear()

        for batch in batches:
            id_type = batch.column(0).type
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                part = batch.column(2)[0].as_py() if part is None else part
                got = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                ids.append(doc.as_py())
                tokens.append(got)
                held += len(got)
                if held >= BLOCK_TOKENS:
                    yield from flush()
        if tokens:
            yield from flush()

    return rows.mapInArrow(run, schema).withColumnRenamed(P + "id", id_col)
