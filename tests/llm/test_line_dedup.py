import random

from lumenflow.llm import line_dedup as D


def all_pairs(texts, least=D.MIN_CHARS):
    """Of every document, the lines in runs of `least` characters that any earlier document has too."""
    runs, lost = {}, {}
    for i in sorted(texts):
        lines = [x.strip(" ") for x in texts[i].split("\n")]
        lost[i], own = set(), []
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += len(lines[b])
                if n >= least:
                    # The shortest run from a on; the shortest one up to b is found from another a.
                    own.append((a, b))
                    break
        for b in range(len(lines)):
            n = 0
            for a in range(b, -1, -1):
                n += len(lines[a])
                if n >= least:
                    own.append((a, b))
                    break
        for a, b in own:
            if runs.get(tuple(lines[a : b + 1]), i) < i:
                lost[i] |= set(range(a, b + 1))
        for a, b in own:
            runs.setdefault(tuple(lines[a : b + 1]), i)
    return lost


def test_patience_pairs_are_common_and_rising():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randint(0, 12) for _ in range(rng.randint(0, 25))] for _ in range(2))
        got = D.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
    assert D.patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]


def test_every_deleted_line_stands_earlier_and_no_line_is_lost(docs, texts):
    out = {r["doc_id"]: r for r in D.dedup_lines(docs).collect()}
    first = {}
    for i in sorted(texts):
        for line in texts[i].split("\n"):
            first.setdefault(line.strip(" "), i)
    kept, gone = set(), 0
    for i, t in texts.items():
        left = out[i]["text"].split("\n")
        n = out[i]["n_deleted"]
        gone += n
        assert len(left) == len(t.split("\n")) - n or n == len(t.split("\n"))
        kept |= {x.strip(" ") for x in left}
        lines = t.split("\n")
        for x in set(lines) - set(left):
            assert first[x.strip(" ")] < i
    assert gone > 100
    assert {x for x in first if len(x) >= D.MIN_CHARS} <= kept
    brute = all_pairs(texts)
    assert {i: out[i]["n_deleted"] for i in texts} == {i: len(x) for i, x in brute.items()}


def test_block_goes_from_the_later_document(spark):
    block = "this is a passage that two documents share\nshort\nand this is its last line of them all"
    df = spark.createDataFrame([(1, f"one line of its own, quite long\n{block}"), (2, f"{block}\nanother line, long enough to tell"), (3, "short\nnothing else is shared here at all")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in D.dedup_lines(df).collect()}
    assert got[1].endswith(block) and got[2] == "another line, long enough to tell" and got[3].startswith("short")


def test_awkward_rows(awkward, nothing):
    out = D.dedup_lines(awkward)
    assert out.columns[: len(awkward.columns)] == awkward.columns and out.count() == awkward.count()
    rows = [r for r in out.collect() if r["doc_id"] is None or r["text"] is None]
    assert all(r["n_deleted"] == 0 for r in rows)
    assert D.dedup_lines(nothing).count() == 0


def test_nothing_stays_that_aligns_with_any_earlier_document(spark):
    rng = random.Random(5)
    long = [f"a shared line of some length, number {i}" for i in range(25)]
    docs = {}
    for i in range(120):
        own = [f"{x}{i}" for x in ("own ", "and a long line that only stands here ", "more ")]
        docs[i] = [x for b in rng.sample(range(24), rng.randint(1, 4)) for x in (long[b], f"s{b % 3}", long[b + 1], *(own[:1] if rng.random() < 0.5 else ()))] + own[1:]
        docs[i] = docs[i] + docs[i][:1] * rng.randint(0, 2)
    got = {r["doc_id"]: r["text"].split("\n") for r in D.dedup_lines(spark.createDataFrame([(i, "\n".join(x)) for i, x in docs.items()], "doc_id long, text string")).collect()}
    code = {x: k for k, x in enumerate({x for d in docs.values() for x in d})}
    for i, d in docs.items():
        lost = set()
        for j in range(i):
            lost |= set(D.common_blocks(D.patience([code[x] for x in d], [code[x] for x in docs[j]]), [len(x) for x in d]))
        left = [x for k, x in enumerate(d) if k not in lost]
        rest = iter(left)
        assert got[i] == [""] or all(x in rest for x in got[i])
        earlier = {x for j in range(i) for x in docs[j]}
        assert not [x for x in got[i] if len(x) >= D.MIN_CHARS and x in earlier]


def test_first_holder_with_the_line_twice_or_in_another_order(spark):
    a, b, c = (f"{x} is a line that is long enough to tell" for x in "abc")
    rows = [(1, f"{a}\nz\n{b}\n{a}\ny\n{c}"), (2, f"{c}\nx\n{a}\nown line of the second document\n{b}"), (3, f"{b}\nt"), (4, f"u\n{b}\nt\nv")]
    got = {r["doc_id"]: r["text"] for r in D.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "x\nown line of the second document", 3: "t", 4: "u\nv"}


def test_short_lines_go_as_blocks_and_any_earlier_holder_counts(spark):
    y, m, x = (f"line {c} is long enough to tell" for c in "YMX")
    rows = [(1, f"{y}\n{m}\n{x}"), (2, f"{x}\n{y}\nown two of the second one"), (3, f"{x}\n{y}\nown three of the third"), (4, "so\nmany\nvery short lines\nhere"), (5, "some\nso\nmany\nvery short lines\nelse"), (6, "so\nmany")]
    got = {r["doc_id"]: r["text"] for r in D.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "own two of the second one", 3: "own three of the third", 4: rows[3][1], 5: "some\nelse", 6: "so\nmany"}


def test_a_line_that_all_documents_have(spark, monkeypatch):
    monkeypatch.setattr(D, "TOGETHER", 10)
    rows = [(i, f"one line that every document of them has\n{i}") for i in range(200)]
    got = {r["doc_id"]: r["text"] for r in D.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: rows[0][1] if i == 0 else str(i) for i in range(200)}
