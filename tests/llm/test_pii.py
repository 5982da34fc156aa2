import random
import re

from lumenflow.llm import pii

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


HAND = ["a@b.c_d@e.f", "x@y", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111 and 4111-1111-1111-1111", "999.1.1.1 001.02.3.4 1.2.3.256", "+1 (743) 555-3824 +44 20 7946 0958..", "😀 é a.b@c.d.e é +49 (30) 1234567", "a@b-.c-..d", "1" * 500, "a" * 50_000, "12 " * 5_000, "%a@b.c+d@e.f", "0000000000000000", "4111111111111111-4", "1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6", "a@b.co " * 3_000, "1 2  3-4 5555555555554444 7", "0000000000255.1.1.1"]


def test_base_equals_plain_patterns(spark, texts):
    rng = random.Random(3)
    rows = [*texts.values(), *HAND, *("".join(rng.choice("0123456789012345 -.+()@ab.%é") for _ in range(rng.randint(1, 120))) for _ in range(800))]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    for i, t in enumerate(rows):
        base = [tuple(s) for s in got[i]["base"]]
        assert base == brute(t), t[:80]
        assert set(base) <= {tuple(s) for s in got[i]["all_spans"]}
        assert [got[i]["n_" + k] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]


def test_trees_add_what_context_supports(spark):
    cases = {"call me: tel (555) 123-4567 today": 1, "write to joe.12 (at) mail (dot) com now": 1, "the version 2.0.1 of 2024-01-02": 0, "order 4111111111111112 shipped": 0, "a table 12 14 16 18 20 22": 0}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    got = [len(r["all_spans"]) for r in pii.find_pii(df).orderBy("doc_id").collect()]
    assert got == list(cases.values())


def test_trees_as_columns_equal_trees_in_numpy(spark):
    import numpy as np
    from pyspark.sql import functions as F

    model = pii.train(spark)
    rng = np.random.default_rng(1)
    x = np.stack([rng.integers(0, 4, 200), rng.integers(5, 40, 200), rng.integers(0, 20, 200), rng.integers(0, 8, 200), *[rng.integers(0, 2, 200) for _ in range(5)]], 1)
    df = spark.createDataFrame([tuple(map(int, r)) for r in x], ", ".join(f"{f} int" for f in pii.FEATURES))
    got = [r[0] for r in df.select(model.column(F.struct(*pii.FEATURES))).collect()]
    assert np.allclose(got, model.probability(x))


def test_recall_on_values_in_other_forms(spark, docs):
    """Values of held-out documents in forms that no base pattern has, and decoys, in those documents' own words."""
    windows = pii.document_windows(docs.filter("doc_id % 2 = 0"))
    model = pii.train(spark, docs.filter("doc_id % 2 = 1"))
    rng, rows = random.Random(8), []
    for kind, found in windows.items():
        for before, hit, after in found[:60]:
            digits = re.sub("[^0-9]", "", hit)
            if kind == "email":
                rows.append((kind, 1, f"{before}{hit.replace('@', rng.choice([' (at) ', '[at]'])).replace('.', '.')}{after}"))
                rows.append((kind, 0, f"{before}{hit.split('@')[0]} @ 12.abc{after}"))
            elif kind == "phone":
                rows.append((kind, 1, f"{before}({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}{after}"))
                rows.append((kind, 0, f"{before}{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}{after}"))
            elif kind == "ip":
                rows.append((kind, 1, f"{before}host {':'.join(f'{rng.randrange(1 << 16):04x}' for _ in range(8))}{after}"))
                rows.append((kind, 0, f"{before}serial {':'.join(f'{rng.randrange(1 << 16):04x}' for _ in range(8))}{after}"))
            else:
                wrong = hit[:-1] + str((int(hit[-1]) + rng.randint(1, 9)) % 10)
                rows.append((kind, 1, f"{before}card {wrong}{after}"))
                rows.append((kind, 0, f"{before}order {wrong}{after}"))
    df = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: len(r["all_spans"]) - len(r["base"]) for r in pii.find_pii(df, model=model).collect()}
    for kind in pii.KINDS:
        told = {y: [got[i] > 0 for i, (k, good, _) in enumerate(rows) if k == kind and good == y] for y in (0, 1)}
        assert sum(told[1]) >= 0.9 * len(told[1]) > 0 and sum(told[0]) <= 0.1 * len(told[0]), (kind, sum(told[1]), sum(told[0]), len(told[1]))


def test_the_model_follows_its_arguments(spark):
    strict, loose = pii.train(spark, precision=0.999, examples=600), pii.train(spark, precision=0.6, examples=600)
    assert strict is not loose and strict is pii.train(spark, precision=0.999, examples=600)
    assert all(a >= b for a, b in zip(strict.thresholds, loose.thresholds, strict=True))


def test_redaction_and_secrets(spark):
    cases = {
        "": "", "nothing here": "nothing here", "a.b@c.de, 10.0.0.1": "[EMAIL], [IP]", "é +49 (30) 1234567 ü": "é [PHONE] ü", "4111 1111 1111 1111": "[CARD]",
        'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y': 'x [SECRET]" y', "token of love = nothing": "token of love = nothing", "password: hunter2hunter2hunter2": "[SECRET]",
        "a@b.co " * 2000: "[EMAIL] " * 2000,
    }
    df = spark.createDataFrame([*[(i, t) for i, t in enumerate(cases)], (99, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_pii(df, redact=True).collect()}
    assert [got[i]["redacted"] for i in range(len(cases))] == list(cases.values()) and got[99]["redacted"] == ""
    assert [len(got[i]["secrets"]) for i in range(len(cases))] == [0, 0, 0, 0, 0, 1, 0, 1, 0]


def test_overlaps_in_runs(spark):
    """Against a plain greedy choice, with spans that chain."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    cases = []
    for _ in range(200):
        spans = [(s := rng.randint(0, 300), s + rng.randint(1, 30), k, round(rng.random(), 3)) for k in range(4) for _ in range(rng.randint(0, 6))]
        cases.append(sorted(spans))
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s array<struct<start:int,end:int,kind:int,p:double>>")
    got = {r["i"]: [[tuple(x)[:3] for x in run] for run in r["c"]] for r in df.select("i", pii._clusters(F.col("s")).alias("c")).collect()}
    for i, c in enumerate(cases):
        runs, top = [], -1
        for s in c:
            if s[0] >= top:
                runs.append([])
            runs[-1].append(s[:3])
            top = max(top, s[1])
        assert got[i] == runs


def test_awkward_rows(spark, awkward, nothing):
    rows = pii.find_pii(awkward).collect()
    assert len(rows) == awkward.count() and set(rows[0].asDict()) == {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "all_spans", "secrets"}
    long = [(1, "call +1 (743) 555-3824 " + "x" * 200_000), (1, "call +1 (743) 555-3824 " + "x" * 200_000), (None, "1.2.3.4")]
    got = pii.find_pii(spark.createDataFrame(long, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_phone"], r["n_ip"]) for r in got) == [(0, 0, 1), (1, 1, 0), (1, 1, 0)]
    assert pii.find_pii(nothing).count() == 0


class Rated:
    """Trees of which a span's probability is what the test says for its start."""

    thresholds = (0.5,) * len(pii.KINDS)

    def __init__(self, by_start):
        self.by_start = by_start

    def column(self, s):
        from pyspark.sql import functions as F

        out = F.lit(0.0)
        for start, p in self.by_start.items():
            out = F.when(s["start"] == start, F.lit(p)).otherwise(out)
        return out


def test_added_spans_are_taken_greedily_in_chains(spark, monkeypatch):
    from pyspark.sql import functions as F

    chain = [(0, 5), (4, 9), (8, 12), (20, 25)]
    spans = F.array(*[F.struct(F.lit(3).alias("kind"), F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in chain])
    monkeypatch.setattr(pii, "proposals", lambda df, text: df.withColumn(pii.P + "proposed", spans))
    df = spark.createDataFrame([(1, "x" * 30)], "doc_id long, text string")
    (r,) = pii.find_pii(df, model=Rated({0: 0.9, 4: 0.8, 8: 0.7, 20: 0.6})).collect()
    assert [(s["start"], s["end"]) for s in r["all_spans"]] == [(0, 5), (8, 12), (20, 25)]
    (r,) = pii.find_pii(df, model=Rated({0: 0.7, 4: 0.9, 8: 0.8, 20: 0.4})).collect()
    assert [(s["start"], s["end"]) for s in r["all_spans"]] == [(4, 9)]
