import random
from itertools import combinations

import numpy as np

from lumenflow.llm import near_dedup as N
from lumenflow.llm.common import word_hashes


def shingles(text):
    return N.shingles((word_hashes(np.frombuffer(text.encode(), np.uint8))[1] >> np.uint64(32)).astype("<u4"))


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


def classes(texts):
    """Least id by document, by alignment of all pairs that share any shingle."""
    sh, holders, tried = {i: shingles(t) for i, t in texts.items()}, {}, set()
    for i, x in sh.items():
        for s in set(x.tolist()):
            holders.setdefault(s, []).append(i)
    up = {i: i for i in texts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    same = {}
    for i, t in texts.items():
        same.setdefault(t, []).append(i)
    for group in same.values():
        for i in group[1:]:
            a, b = find(i), find(group[0])
            up[max(a, b)] = min(a, b)
    for group in holders.values():
        tried |= set(combinations(sorted(group), 2))
    for i, j in sorted(tried):
        if min(len(sh[i]), len(sh[j])) >= 0.8 * max(len(sh[i]), len(sh[j])) and N.aligned_similarity(sh[i], sh[j]) >= 0.8:
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def test_alignment_equals_plain_lcs():
    rng = random.Random(5)
    for _ in range(200):
        a = [rng.randint(0, 30) for _ in range(rng.randint(1, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 2)] = [rng.randint(0, 30) for _ in range(rng.randint(0, 2))]
        n = plain_lcs(a, b)
        want = n / (len(a) + len(b) - n)
        got = N.aligned_similarity(np.array(a, np.uint64), np.array(b, np.uint64)) if b else 0
        assert abs(got - (want if want >= 0.8 else 0)) < 1e-12


def test_classes_equal_brute_force(docs, texts):
    want = classes(texts)
    got = {r["doc_id"]: r for r in N.near_dedup(docs).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == want
    assert sorted(i for i, r in got.items() if r["kept"]) == sorted(set(want.values()))
    kept = N.distinct_documents(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(set(want.values()))


def test_chains_and_stars_of_near_copies(spark):
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(200)]
    texts, current = {0: " ".join(base)}, base
    for i in range(1, 40):  # each a few words from the one before, and from the base
        current = list(current)
        current[rng.randrange(200)] = f"v{i}"
        texts[i] = " ".join(current)
        star = list(base)
        for _ in range(3):
            star[rng.randrange(200)] = f"u{i}"
        texts[100 + i] = " ".join(star)
    got = {r["doc_id"]: r["class_id"] for r in N.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == classes(texts)


def test_awkward_rows(awkward, nothing):
    rows = N.near_dedup(awkward).collect()
    assert len(rows) == awkward.count()
    assert sum(r["kept"] for r in rows) == N.distinct_documents(awkward).count() == len({r["class_id"] for r in rows})
    assert N.near_dedup(nothing).count() == 0 and N.distinct_documents(nothing).count() == 0


def test_alignment_within_the_band_equals_the_whole_table():
    import random

    import numpy as np

    from lumenflow.llm import near_dedup

    rng = random.Random(11)
    for trial in range(120):
        n, letters = rng.choice([5, 40, 300, 1500 if trial % 30 == 0 else 90]), rng.choice([2, 30, 10_000])
        a = [rng.randrange(letters) for _ in range(n)]
        b = list(a)
        for _ in range(rng.randint(0, max(1, n // 12))):
            k = rng.randrange(len(b))
            b[k : k + rng.randint(0, 2)] = [rng.randrange(letters) for _ in range(rng.randint(0, 2))]
            b = b or [0]
        before = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
            before = row
        want = before[-1] / (len(a) + len(b) - before[-1])
        got = near_dedup.aligned_similarity(np.array(a, np.uint64), np.array(b, np.uint64))
        assert abs(got - (want if want >= 0.8 else 0.0)) < 1e-12, (n, letters, want, got)
