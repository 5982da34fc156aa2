import hashlib

import numpy as np

from lumenflow.llm import fingerprint as P


def jaccard(a, b):
    x, y = (dict(zip(*(v.tolist() for v in P.weighted_terms(t.encode())), strict=True)) for t in (a, b))
    keys = set(x) | set(y)
    return sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / max(1, sum(max(x.get(k, 0), y.get(k, 0)) for k in keys))


def test_collision_rate_is_generalised_jaccard():
    """Weights of all sizes, over and under those that have tables."""
    rng = np.random.default_rng(4)
    error = []
    for _ in range(150):
        terms = rng.integers(0, 1 << 63, 60).astype(np.uint64)
        a, b = rng.integers(1, 40, 60), rng.integers(1, 40, 60)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        error.append(P.likeness(P.signature(terms, a), P.signature(terms, b)) - want)
    assert abs(np.mean(error)) < 0.015 and np.std(error) < 0.06


def test_least_values_are_exponential_variates_of_the_weight():
    rng = np.random.default_rng(7)
    for weight in (1, 2, 7, 40):
        values = np.concatenate([P.least_terms(rng.integers(0, 1 << 63, 1).astype(np.uint64), np.array([weight]))[0] for _ in range(400)])
        assert abs(values.mean() * weight - 1) < 0.03 and abs(np.median(values) * weight - np.log(2)) < 0.03


def test_whole_table(docs, texts):
    got = {r["doc_id"]: r for r in P.edited_fingerprints(docs).collect()}
    ids, error = sorted(texts), []
    assert sorted(got) == ids
    for k, i in enumerate(ids):
        text, after, r = texts[i], texts[ids[(k + 1) % len(ids)]], got[i]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        error.append((r["near_edited"] - jaccard(text, edited), r["near_next"] - jaccard(text, after)))
    assert abs(np.mean(error)) < 0.01 and np.std(error) < 0.05
    by = {}
    for i in ids:
        assert by.setdefault(texts[i], got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert {r["doc_id"]: r["fingerprint"] for r in P.fingerprints(docs).collect()} == {i: got[i]["fingerprint"] for i in ids}


def test_awkward_rows(spark, awkward, nothing):
    rows = P.edited_fingerprints(awkward).collect()
    assert len(rows) == awkward.count()
    assert all(r["fingerprint"] == "0" * 4 * P.SAMPLES for r in rows if r["n_chars"] == 0)
    assert P.edited_fingerprints(nothing).count() == 0
    (one,) = P.edited_fingerprints(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1


def test_signatures_do_not_depend_on_how_sets_are_split(texts):
    some = [P.weighted_terms(t.encode()) for t in list(texts.values())[:60]]
    for a, b in zip(some, some[1:], strict=False):
        for x, y in zip(P.two_signatures(a, b), (P.signature(*a), P.signature(*b)), strict=True):
            assert np.array_equal(x, y)
    # Equal values: the term that comes first in the whole set wins, whichever part it is in.
    tie = lambda term, code: (np.zeros(1), np.array([code], np.uint16), np.array([False]), np.array([term], np.uint64))
    assert P.together(tie(1, 5), tie(2, 6))[0] == P.together(tie(2, 6), tie(1, 5))[0] == 5


def test_long_texts_are_hashed_in_pieces():
    text = " ".join(f"w{i % 5003}" for i in range(40_000)).encode()
    for got, want in zip(P.weighted_terms(text, 1000), P.weighted_terms(text, 1 << 30), strict=True):
        assert np.array_equal(got, want)


def test_rows_of_one_id_and_text(spark):
    rows = [(None, "a b c d")] * 30 + [(1, "e f g h")] * 30
    got = P.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 60 and {r["near_next"] for r in got} == {0.0, 1.0} and sum(r["near_next"] == 0 for r in got) == 2


def test_likeness_of_texts_with_several_hundred_thousand_pairs():
    rng = np.random.default_rng(9)
    error = []
    for _ in range(6):
        a = rng.integers(0, 1 << 63, 300_000).astype(np.uint64)
        b = np.concatenate((a[75_000:], rng.integers(0, 1 << 63, 75_000).astype(np.uint64)))
        one = np.ones(len(a), np.int64)
        error.append(P.likeness(P.signature(a, one), P.signature(b, one)) - 0.6)
    assert abs(np.mean(error)) < 0.05
