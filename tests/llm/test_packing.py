import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenflow.llm import packing


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_tokenizers(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")) if not hasattr(test_ids_equal_the_tokenizers, "t") else test_ids_equal_the_tokenizers.t
    test_ids_equal_the_tokenizers.t = t
    assert packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))(text) == t.encode(text, add_special_tokens=False).ids


def test_long_runs_and_special_strings(plain):
    e = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("a" * 20_000, " " * 9_000, "\n \t" * 4_000, "<|endoftext|> x", "a<|endoftext|><|endoftext|>\n", "<|endoftext|", "é" * 5_000 + " ok"):
        assert e(text) == plain(text)
    assert e("<|endoftext|> x") == [50256, 2124]
    # Around the length from which tokenizers itself is used, for every class of pre-token.
    for unit in ("a", "7", " ", "\n", "!", "é", "漢", "🙂", "\u0301", "\u00a0", "'s", "aB", "\r\n", " \t"):
        for n in (packing.LONG_RUN - 3, packing.LONG_RUN - 1, packing.LONG_RUN, packing.LONG_RUN + 1):
            for text in (unit * n, "x " + unit * n + " y", (unit * (n // 2) + " ") * 2):
                assert e(text) == plain(text)


def test_ids_of_all_documents_equal_the_tokenizers(texts, plain):
    e = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(e(t) == plain(t) for t in texts.values())


@given(st.lists(st.integers(1, 40), max_size=25), st.integers(1, 60))
@settings(max_examples=200, deadline=None)
def test_fill_is_the_best_subset_sum(lengths, room):
    counts = [lengths.count(k) for k in range(max(lengths, default=0) + 1)] or [0]
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums if s + n <= room}
    got = packing.fill(counts, room)
    assert sum(k * n for k, n in got.items()) == max(sums) and all(n <= counts[k] for k, n in got.items())


@given(st.lists(st.integers(1, 300), min_size=1, max_size=60))
@settings(max_examples=200, deadline=None)
def test_blocks_round_trip_without_padding(lengths):
    pieces, filled = defaultdict(list), defaultdict(list)
    for d, start, n, seq, at in packing.pack_block(np.array(lengths), 64):
        pieces[d].append((start, n))
        filled[seq].append((at, n))
    for d, n in enumerate(lengths):
        at = 0
        for start, k in sorted(pieces[d]):
            assert start == at
            at += k
        assert at == n
    for parts in filled.values():
        at = 0
        for start, k in sorted(parts):
            assert start == at
            at += k
        assert at <= 64 and (at == 64 or at & (at - 1) == 0)


def test_query_rebuilds_every_document(docs, texts, plain):
    got, short = defaultdict(list), packing.pack(docs, digest=True).collect()
    for r in packing.pack(docs).collect():
        got[r["doc_id"]].append((r["start"], r["ids"], r["doc_tokens"]))
    assert set(got) == set(texts)
    for i in list(texts)[:200]:
        ids = [k for _, part, _ in sorted(got[i]) for k in part]
        assert ids == [*plain(texts[i]), 1] and got[i][0][2] == len(ids)
    crc = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in short}
    assert all(crc[i, s] == zlib.crc32(np.array(p, "<u4").tobytes()) for i, v in got.items() for s, p, _ in v)


def test_awkward_rows(awkward, nothing):
    rows = packing.pack(awkward).collect()
    assert {r["doc_tokens"] for r in rows if r["doc_id"] in (0, 1)} == {1}
    assert sum(r["start"] == 0 for r in rows) == awkward.count()
    assert packing.pack(nothing).count() == 0
