"""Personal data: base patterns, high-recall generators, and boosted trees that select what generators propose for redaction."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import P, text_of

KINDS = ("email", "ip", "card", "phone")

#: The base patterns, in forms that find the same spans in linear time: a run is entered only at its
#: start (or where the last match ended) and never given back, so long runs don't backtrack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Proposals beyond the base: written-out addresses, numbers without country code or check digit, long addresses.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\)|@)\x20?[A-Za-z0-9-]++(?:(?:\x20?(?:\[dot\]|\(dot\))\x20?|\.)[A-Za-z0-9-]++){1,5}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![0-9A-Za-z-])",
}
#: Secrets: a name that says so, then a long value without blanks that has digits. They stand apart from the four kinds.
SECRET = r"(?i)(?<![a-z0-9])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|private[_-]?key)\x20?[:=]\x20?[\"']?(?=[a-z0-9+/_-]{0,200}[0-9])[a-z0-9+/_-]{16,200}"
#: Words before a span that speak for or against each kind.
CONTEXT = {
    "email": "mail|contact|write|address|reply",
    "ip": "ip|host|server|client|peer|address",
    "card": "card|visa|credit|debit|pay|amex",
    "phone": "tel|phone|call|fax|mobile|cell",
}
AGAINST = "order|invoice|serial|version|part|isbn|model|batch|token|code|item|ref|date|no\\."
FEATURES = ("kind", "length", "digits", "marks", "luhn", "for_it", "against_it", "glued", "shape")


def _prefix(steps: Column) -> Column:
    """Running sums before each element, in blocks so that a text with very many spans costs little more than its length."""
    run = lambda a: F.aggregate(a, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    total = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / 512).cast("int")), lambda b: F.slice(steps, b * 512 + 1, 512))
    ahead = F.slice(run(F.transform(blocks, total)), 1, F.size(blocks))
    return F.flatten(F.zip_with(blocks, ahead, lambda block, base: F.transform(F.slice(run(block), 1, F.size(block)), lambda v: v + base)))


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(digits)
    at = F.sequence(F.lit(1), F.length(digits))

    def term(i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(at, F.lit(0), lambda acc, i: acc + term(i)) % 10 == 0


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _spans(df: DataFrame, text: str, name: str, pattern: str, gate: Column) -> DataFrame:
    """A column of all leftmost non-overlapping matches: array of (start, end, hit), in code points."""
    hits, gaps, steps = f"{name}_hits", f"{name}_gaps", f"{name}_steps"
    none = F.array().cast("array<string>")
    df = df.withColumn(hits, F.when(gate, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(gaps, F.when(F.size(hits) > 0, F.transform(F.split(F.col(text), pattern), F.length)).otherwise(F.array().cast("array<int>")))
    df = df.withColumn(steps, F.zip_with(F.slice(gaps, 1, F.size(hits)), F.col(hits), lambda g, h: F.struct(g.alias("gap"), F.length(h).alias("n"), h.alias("hit"))))
    before = F.when(F.size(hits) > 0, _prefix(F.transform(steps, lambda s: s["gap"] + s["n"]))).otherwise(F.array().cast("array<int>"))
    out = F.zip_with(before, F.col(steps), lambda at, s: F.struct((at + s["gap"]).alias("start"), (at + s["gap"] + s["n"]).alias("end"), s["hit"].alias("hit")))
    return df.withColumn(name, out).drop(hits, gaps, steps)


def _valid(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # A part of any length is compared without its leading zeros.
        bare = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(hit, r"\."), lambda p: F.when(F.length(bare(p)) > 3, False).otherwise(F.concat(F.lit("0"), bare(p)).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(hit)).between(13, 19) & _luhn(_digits(hit))
    return F.length(_digits(hit)).between(9, 15)


def _holds(kind: str):
    return lambda s: _valid(kind, s["hit"])


def _gates(text: str) -> dict[str, Column]:
    """What a text must hold for a pattern to have any match."""
    t = F.col(text)
    digit = t.rlike("[0-9]")
    return {"email": t.contains("@"), "ip": digit, "card": digit, "phone": t.contains("+")}


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Columns __lf_email, __lf_ip, __lf_card, __lf_phone: the base spans that hold."""
    for kind, gate in _gates(text).items():
        df = _spans(df, text, P + kind + "_all", BASE[kind], gate)
        df = df.withColumn(P + kind, F.filter(P + kind + "_all", _holds(kind))).drop(P + kind + "_all")
    return df


def proposals(df: DataFrame, text: str) -> DataFrame:
    """A column __lf_proposed: array of candidates of all kinds with their features; they may overlap."""
    t = F.col(text)
    gates = {"email": t.contains("@") | t.contains("(at)") | t.contains("[at]"), "ip": t.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]"), "card": t.rlike("[0-9]{4}"), "phone": t.rlike(r"[0-9][0-9)][ .-]?[0-9]{2}")}
    for kind in KINDS:
        df = _spans(df, text, P + kind + "_new", GENERATORS[kind], gates[kind])

    def features(k: int, kind: str):
        def one(s: Column) -> Column:
            hit, digits = s["hit"], _digits(s["hit"])
            before = F.lower(F.substring(t, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24))))
            fields = [
                F.lit(k).alias("kind"), F.length(hit).alias("length"), F.length(digits).alias("digits"), F.length(F.regexp_replace(hit, "[0-9A-Za-z]", "")).alias("marks"),
                F.when(F.length(digits).between(13, 19) & _luhn(digits), 1).otherwise(0).alias("luhn"),
                before.rlike(rf"\b(?:{CONTEXT[kind]})").cast("int").alias("for_it"), before.rlike(rf"\b(?:{AGAINST})").cast("int").alias("against_it"),
                F.substring(before, -1, 1).rlike("[0-9A-Za-z_=/#\"']").cast("int").alias("glued"),
                hit.rlike(r"^\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}$|[@)\]]\x20?[A-Za-z][A-Za-z0-9-]*[\x20(\[.].*[A-Za-z]{2,}$").cast("int").alias("shape"),
            ]
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), *fields)

        return one

    lists = [F.transform(P + kind + "_new", features(k, kind)) for k, kind in enumerate(KINDS)]
    return df.withColumn(P + "proposed", F.concat(*lists)).drop(*[P + k + "_new" for k in KINDS])


@dataclass
class Trees:
    """Boosted regression trees over whole-number features, their calibration and thresholds."""

    trees: list = field(default_factory=list)
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    thresholds: tuple = (0.5,) * len(KINDS)

    def raw(self, x: np.ndarray) -> np.ndarray:
        def walk(node, rows):
            if not isinstance(node, tuple):
                return np.full(len(rows), node)
            f, cut, left, right = node
            out, low = np.empty(len(rows)), rows[:, f] <= cut
            out[low], out[~low] = walk(left, rows[low]), walk(right, rows[~low])
            return out

        return self.bias + sum((walk(t, x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))

    def column(self, s: Column) -> Column:
        """The same probability as a column over a candidate's struct."""

        def expr(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            f, cut, left, right = node
            return F.when(s[FEATURES[f]] <= cut, expr(left)).otherwise(expr(right))

        total = F.lit(float(self.bias))
        for t in self.trees:
            total = total + expr(t)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(float(self.slope)) * total + F.lit(float(self.shift)))))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3) -> Trees:
    """Gradient boosting of the logistic loss with Newton leaves; splits are searched exactly."""
    out = Trees(bias=float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))))
    score = np.full(len(y), out.bias)

    def grow(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, level: int):
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None)
        for f in range(x.shape[1]) if level < depth else ():
            for cut in np.unique(x[rows, f])[:-1]:
                low = x[rows, f] <= cut
                if min(low.sum(), (~low).sum()) >= 8:
                    gl, hl = grad[rows][low].sum(), hess[rows][low].sum()
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > best[0]:
                        best = (gain, (f, int(cut), low))
        if best[1] is None:
            return round(float(rate * g / (h + 1)), 6)
        f, cut, low = best[1]
        return f, cut, grow(rows[low], grad, hess, level + 1), grow(rows[~low], grad, hess, level + 1)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), 0)
        out.trees.append(tree)
        score = out.raw(x)
    return out


Surroundings = tuple[str, str, str]


def document_windows(docs: DataFrame, text_col: str = "text", rows: int = 20_000, most: int = 200) -> dict[str, list[Surroundings]]:
    """What stands before, in and after base spans of a bounded sample: of about `rows` documents, chosen by a hash of the
    text, at most `most` spans of each kind.
    """
    share = min(1.0, rows / max(docs.count(), 1))
    text = text_of(text_col)
    chosen = docs.filter(F.pmod(F.xxhash64(text, F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(text.alias(P + "text"))
    found = base_spans(chosen, P + "text")
    t = F.col(P + "text")
    of = lambda kind: F.transform(P + kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit")))
    spans = found.select(t, F.explode(F.concat(*[of(k) for k in KINDS])).alias("s"))
    before = F.substring(t, F.greatest(F.col("s.start") - 39, F.lit(1)), F.least(F.col("s.start"), F.lit(40)))
    each = spans.select(F.col("s.kind").alias("kind"), before.alias("before"), F.col("s.hit").alias("hit"), F.substring(t, F.col("s.end") + 1, F.lit(40)).alias("after"))
    order = Window.partitionBy("kind").orderBy(F.xxhash64("before", "hit", "after"), "before", "hit", "after")
    out = each.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most)
    got: dict[str, list[Surroundings]] = {k: [] for k in KINDS}
    for r in out.collect():
        got[r["kind"]].append((r["before"], r["hit"], r["after"]))
    return {k: sorted(v) for k, v in got.items()}


def _examples(windows: dict[str, list[Surroundings]], n: int = 2400, seed: int = 5) -> list[tuple[str, int, int]]:
    """(text, kind, label): one proposal each, true or not, in surroundings that speak for, against or neither.

    Surroundings and values are those of base spans of the documents, where there are any: a true one is such a value
    written in another form (an address spelt out, a number without its country code), a false one is corrupted (a check
    digit that fails, a date, a row of numbers) or stands after words that say it is something else.
    """
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    w = lambda: "".join(rng.choice("aeinorstlm") for _ in range(rng.randint(3, 9)))
    around = [(a, c) for v in windows.values() for a, _, c in v]

    def card(valid: bool) -> str:
        while True:
            s = d(16)
            total = sum(int(c) if i % 2 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(s))
            if (total % 10 == 0) == valid:
                sep = rng.choice(["", " ", "-"])
                return sep.join(s[i : i + 4] for i in range(0, 16, 4))

    for_it = {"email": ["email: ", "contact ", "write to "], "ip": ["server ", "host ", "ip "], "card": ["card ", "visa ", "paid by credit card "], "phone": ["tel ", "phone: ", "call ", "mobile "]}
    against = ["order ", "invoice ", "serial ", "version ", "part ", "batch ", "model ", "item "]
    out = []
    for i in range(n):
        k = i % 4
        kind = KINDS[k]
        lead = rng.choice(["for", "against", "none", "none"])
        before, after = rng.choice(around) if around and rng.random() < 0.5 else (f"{w()} {w()} ", f" {w()} {w()}")
        value = rng.choice(windows[kind])[1] if windows.get(kind) and rng.random() < 0.5 else None
        context = rng.choice(for_it[kind]) if lead == "for" else rng.choice(against) if lead == "against" else ""
        if kind == "email":
            at, dot = rng.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", "."), ("(at)", "(dot)")])
            good = rng.random() < 0.6
            name, _, host = (value or f"{w()}.{d(2)}@{w()}.{rng.choice(['com', 'org', 'net'])}").partition("@")
            text = name + at + host.replace(".", dot) if good else f"{w()} @ {d(2)}.{w()[:4]}"
        elif kind == "ip":
            text, good = ":".join("".join(rng.choice("0123456789abcdef") for _ in range(4)) for _ in range(8)), lead != "against"
        elif kind == "card":
            luhn = rng.random() < 0.4
            text, good = card(luhn), luhn and lead != "against" or lead == "for"
        else:
            digits = "".join(c for c in value or "" if c.isdigit())[-10:]
            digits = digits if len(digits) == 10 else d(10)
            shape = rng.choice(["({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}"])
            text, good = shape.format(digits[:3], digits[3:6], digits[6:]), lead == "for" or shape[0] == "(" and lead == "none"
            other = rng.random()
            if other < 0.2:
                text, good = f"{d(4)}-{d(2)}-{d(2)}", False
            elif other < 0.6:  # a row of numbers
                sep = rng.choice([" ", ".", "-"])
                text, good = sep.join(d(rng.choice([2, 2, 3, 4])) for _ in range(rng.randint(3, 5))), False
        out.append((before + context + text + after, len(before + context), k, int(good)))
    return [(t, at, k, y) for t, at, k, y in out]


_trained: dict[tuple, Trees] = {}


def train(spark: SparkSession, docs: DataFrame | None = None, text_col: str = "text", precision: float = 0.97, rows: int = 20_000, most: int = 200, examples: int = 2400) -> Trees:
    """Fit on `examples` proposals in surroundings of the documents' own base spans (see document_windows for the bounds
    `rows` and `most`), whose features the main path's own expressions compute; without documents, in invented words. A
    third of them calibrates the probability and each kind's threshold, the least that keeps `precision` on that third.
    """
    windows = document_windows(docs, text_col, rows, most) if docs is not None else {}
    made = _examples(windows, examples)
    key = (precision, hash(tuple(made)))
    if key in _trained:
        return _trained[key]
    df = spark.createDataFrame([(i, t, at, k, y) for i, (t, at, k, y) in enumerate(made)], "i int, text string, at int, k int, y int")
    found = proposals(df, "text").select("i", "at", "k", "y", F.explode(P + "proposed").alias("s")).filter("s.kind = k AND s.start >= at - 1 AND s.start <= at + 2").orderBy("i", "s.start").collect()
    x = np.array([[r["s"][f] for f in FEATURES] for r in found], np.int64)
    y, fold = np.array([r["y"] for r in found], np.float64), np.array([r["i"] for r in found]) // 4 % 3
    model = boost(x[fold > 0], y[fold > 0])
    raw, want = model.raw(x[fold == 0]), y[fold == 0]
    a, b = 1.0, 0.0
    for _ in range(50):  # Platt's scaling by Newton's method
        p = 1 / (1 + np.exp(-(a * raw + b)))
        g, h = np.array([((p - want) * raw).sum(), (p - want).sum()]), p * (1 - p) + 1e-6
        m = np.array([[(h * raw * raw).sum() + 1e-3, (h * raw).sum()], [(h * raw).sum(), h.sum() + 1e-3]])
        da, db = np.linalg.solve(m, g)
        a, b = a - da, b - db
    model.slope, model.shift = round(float(a), 6), round(float(b), 6)
    prob, kinds, cuts = model.probability(x[fold == 0]), x[fold == 0][:, 0], []
    for k in range(len(KINDS)):
        p, w = prob[kinds == k], want[kinds == k]
        good = [c for c in np.unique(p) if w[p >= c].mean() >= precision]
        cuts.append(round(max(float(min(good)) - 1e-9, 0.5), 9) if good else 1.1)
    model.thresholds = tuple(cuts)
    if len(_trained) > 16:
        _trained.clear()
    _trained[key] = model
    return model


def _running_max(values: Column) -> Column:
    """The greatest value before each element (0 before the first), in blocks as _prefix."""
    run = lambda a, first: F.aggregate(a, F.array(first), lambda acc, x: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), x))))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / 512).cast("int"))), lambda b: F.slice(values, b * 512 + 1, 512))
    ahead = F.slice(run(F.transform(blocks, lambda a: F.array_max(a)), F.lit(0)), 1, F.size(blocks))
    return F.flatten(F.zip_with(blocks, ahead, lambda block, first: F.slice(run(block, first), 1, F.size(block))))


def _clusters(spans: Column) -> Column:
    """Spans in order of their starts, cut where one starts at or after all ends before it: array of arrays."""
    opens = F.zip_with(_running_max(F.transform(spans, lambda s: s["end"])), spans, lambda top, s: s["start"] >= top)
    at = F.filter(F.transform(opens, lambda o, i: F.when(o, i)), lambda i: i.isNotNull())
    until = F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(spans)))
    return F.filter(F.zip_with(at, until, lambda i, j: F.slice(spans, i + 1, j - i)), lambda run: run.isNotNull())


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Trees | None = None, redact: bool = False) -> DataFrame:
    """A row per document: id_col, n_email, n_ip, n_card, n_phone (base spans), base (spans by kind, then start), all_spans
    (with what the trees add): arrays of (kind, start, end), in code points, end exclusive, and secrets (start, end). With
    `redact`, redacted too: the text with what any span covers replaced by the kind's name in brackets.

    An added span overlaps no base span and no added one of higher probability. Null text counts as empty, an empty
    text has no spans. Rows that repeat are judged one by one; ties of probability go to the earlier start, then to the
    kind listed first. Spans are compared only within runs that overlap each other, so a very long text with very many
    costs little more than its length. An empty table gives an empty result; columns other than id and text are
    ignored, whatever their names. Everything is a column expression: no shuffle, no Python.
    """
    model = model or train(docs.sparkSession, docs, text_col)
    df = docs.select(F.col(id_col).alias(P + "id"), text_of(text_col).alias(P + "text"))
    df = proposals(base_spans(df, P + "text"), P + "text")
    df = _spans(df, P + "text", P + "secret", SECRET, F.lower(P + "text").rlike("token|secret|passw|key"))
    span = lambda s, kind, p: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind"), p.alias("p"))
    based = lambda n, k: F.transform(P + k, lambda s: span(s, F.lit(n), F.lit(2.0)))
    df = df.withColumn(P + "base", F.concat(*[based(n, k) for n, k in enumerate(KINDS)]))
    cut = lambda kind: F.element_at(F.array(*[F.lit(float(c)) for c in model.thresholds]), kind + 1)
    df = df.withColumn(P + "rated", F.filter(F.transform(P + "proposed", lambda s: span(s, s["kind"], model.column(s))), lambda s: s["p"] >= cut(s["kind"])))
    df = df.withColumn(P + "together", F.array_sort(F.concat(P + "base", P + "rated")))
    # In a run of overlapping spans: by falling probability, base ones first; each is taken if none taken before overlaps it.
    meets = lambda acc, s: F.exists(acc, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))
    taken = lambda acc, s: F.when((s["p"] < 2) & meets(acc, s), acc).otherwise(F.concat(acc, F.array(s)))
    ranked = lambda run: F.transform(F.array_sort(F.transform(run, lambda s: F.struct((-s["p"]).alias("p"), s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), (-s["p"]).alias("p")))
    chosen = F.flatten(F.transform(_clusters(F.col(P + "together")), lambda run: F.when(F.size(run) == 1, run).otherwise(F.aggregate(ranked(run), F.filter(run, lambda s: F.lit(False)), taken))))
    df = df.withColumn(P + "all", F.when(F.size(P + "rated") > 0, chosen).otherwise(F.col(P + "base")))
    by_kind = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    name = lambda a: F.transform(a, lambda s: F.struct(F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    secrets = F.transform(P + "secret", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    more = []
    if redact:
        # Runs of overlapping spans become one piece each, named after the first.
        hidden = F.transform(P + "secret", lambda s: span(s, F.lit(len(KINDS)), F.lit(2.0)))
        df = df.withColumn(P + "runs", F.transform(_clusters(F.array_sort(F.concat(P + "all", hidden))), lambda run: F.struct(run[0]["start"].alias("start"), F.array_max(F.transform(run, lambda s: s["end"])).alias("end"), run[0]["kind"].alias("kind"))))
        runs, text = F.col(P + "runs"), F.col(P + "text")
        from_ = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["end"]))
        to = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.length(text)))
        plain = F.zip_with(from_, to, lambda i, j: F.substring(text, i + 1, j - i))
        label = F.transform(runs, lambda r: F.concat(F.lit("["), F.element_at(F.array(*[F.lit(k.upper()) for k in (*KINDS, "secret")]), r["kind"] + 1), F.lit("]")))
        more.append(F.when(F.size(runs) == 0, text).otherwise(F.array_join(F.zip_with(plain, F.concat(label, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")).alias("redacted"))
    return df.select(
        F.col(P + "id").alias(id_col), *[F.size(P + k).cast("long").alias("n_" + k) for k in KINDS],
        name(by_kind(F.col(P + "base"))).alias("base"), name(by_kind(F.col(P + "all"))).alias("all_spans"), secrets.alias("secrets"), *more,
    )


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
