"""URL filters: pattern rules indexed by their rarest literal token; only candidate rules run their pattern."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P

TOKEN = r"[0-9A-Za-z]+"


@dataclass(frozen=True)
class Rule:
    """A pattern over `host/path`. `priority` ranks fits, longest first; `named` rules are reported by name."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    priority: int
    named: bool = True


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host with all its subdomains and the paths that start with `path`.

    Literal tokens are those that any fitting url has whole: the host's, and the path's but for a last one
    that the prefix may cut. Host labels are lower case; paths keep their case.
    """
    pieces = re.findall(TOKEN, path)
    if pieces and re.search(TOKEN + r"\Z", path):
        pieces.pop()
    tokens = tuple(dict.fromkeys(re.findall(TOKEN, host.lower()) + pieces))
    return Rule(host + path, rf"^(?:[^/?#]*\.)?{_quote(host.lower())}{_quote(path)}", tokens, verdict, 1000 + len(host) + len(path))


def required_tokens(pattern: str) -> tuple[str, ...]:
    """Tokens that stand whole in every text that the pattern fits: literal runs with a border on either side. Of branches,
    only those that all of them have; nothing optional counts, and nothing where case is ignored.
    """

    def of(items) -> dict[str, None]:
        found: dict[str, None] = {}
        run, open_ = "", False  # open_: whether the run begins at a border

        def close(border: bool) -> None:
            nonlocal run
            if run and open_ and border:
                found[run] = None
            run = ""

        for kind, value in items:
            if kind is sre.LITERAL and re.fullmatch(TOKEN, chr(value)):
                run += chr(value)
                continue
            border = kind is sre.LITERAL or kind is sre.AT and value is sre.AT_BOUNDARY
            close(border)
            open_ = border or kind is sre.AT and value in (sre.AT_BEGINNING, sre.AT_BEGINNING_STRING)
            if kind is sre.SUBPATTERN and not value[1] & re.IGNORECASE:
                found |= of(value[3])
            elif kind is sre.BRANCH:
                each = [of(x) for x in value[1]]
                found |= {t: None for t in each[0] if all(t in x for x in each)}
            elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] > 0:
                found |= of(value[2])
        close(False)
        return found

    parsed = sre_parser.parse(pattern)
    return () if parsed.state.flags & re.IGNORECASE else tuple(of(parsed))


def pattern_rule(name: str, pattern: str, verdict: str = "block") -> Rule:
    """A general rule, filed under one of the tokens that its pattern needs; without any it runs on every url."""
    return Rule(name, pattern, required_tokens(pattern), verdict, 0, named=False)


def rules_of(table: DataFrame, most: int = 100_000) -> tuple[Rule, ...]:
    """Site rules from a table of (verdict, host, path), in order of host, path and verdict; more than `most` are an error."""
    rows = table.select("verdict", "host", "path").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return tuple(site_rule(r["verdict"], r["host"], r["path"]) for r in sorted(rows, key=lambda r: (r["host"], r["path"], r["verdict"])))


def _quote(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z/])", r"\\\1", text)


#: The contract's rules: fixed values.
SITE_RULES = (
    site_rule("allow", "com", "/"),
    site_rule("block", "example.com", "/en/"),
    site_rule("allow", "www.example.com", "/en/"),
    site_rule("block", "net", "/es/"),
    site_rule("block", "net", "/fr/"),
)
#: The method's own rules, for urls that no site rule fits.
PATTERN_RULES = (
    pattern_rule("spam host", r"^[^/]*\bspam\b[^/]*"),
    pattern_rule("farm host", r"^[^/]*\b(?:link|content|click|spam)-farm\b"),
    pattern_rule("pills", r"\b(?:cheap|discount|online)-pills\b"),
    pattern_rule("meds", r"\b(?:cheap|discount|online)-meds\b"),
    pattern_rule("casino", r"\bcasino\b"),
    pattern_rule("poker", r"\bpoker\b"),
    pattern_rule("porn", r"\bporn\b"),
    pattern_rule("xxx", r"\bxxx\b"),
    pattern_rule("adult", r"^(?:[^/]*\.)?\badult\.|/adult/"),
    pattern_rule("warez", r"\bwarez\b"),
    pattern_rule("torrent", r"\.torrent\b|/torrent/"),
    pattern_rule("phishing", r"\bfree-(?:money|iphone|gift)\b"),
)

_ENTRY = "struct<t:string,pattern:string,priority:int,k:int,rule:string,verdict:string>"


def _index(rules: Sequence[Rule], seen: dict[str, int]) -> tuple[Column, Column, int]:
    """The rules as two constants: slots of a hash table, each with the entries whose token falls there, and the entries
    of rules without a token. Their size is that of the rule list.
    """
    size = 1 << max(4, len(rules).bit_length() + 1)
    filed: dict[str, list[dict]] = {}
    always = []
    for k, r in enumerate(rules):
        token = min(r.tokens, key=lambda t: (seen.get(t, 0), t)) if r.tokens else None
        entry = {"t": token, "pattern": r.pattern, "priority": r.priority, "k": -k, "rule": r.name if r.named else None, "verdict": r.verdict}
        (filed.setdefault(token, []) if token else always).append(entry)
    slots: list[list[dict]] = [[] for _ in range(size)]
    for token, entries in filed.items():
        slots[_slot(token, size)] += entries
    constant = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)  # noqa: E731  folded once, while planning
    return constant(slots, f"array<array<{_ENTRY}>>"), constant(always, f"array<{_ENTRY}>"), size


def _slot(token: str, size: int) -> int:
    import zlib

    return zlib.crc32(token.encode()) % size


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = SITE_RULES + PATTERN_RULES, default: str = "allow") -> DataFrame:
    """A row per page: id_col, host, path, rule, verdict.

    Each rule is filed under the one of its literal tokens that fewest urls have, in a hash table that is a constant of the
    plan; a url's tokens fetch the entries of their slots, however many rules there are, and only those run their
    regular expression. Of the rules that fit, the highest priority wins (site rules by length, before pattern
    rules; of equal ones the first); else `default` holds. Rules without a literal token run on every url.

    A url without `://`, null or empty, has empty host and path and fits nothing. A very long url costs its tokens. Rows
    that repeat an id are judged one by one. An empty table gives an empty result; other columns are ignored.
    """
    url, found = F.col(url_col), F.instr(F.col(url_col), "://")
    rest = F.when(found > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise(F.lit(""))
    parsed = pages.select(F.col(id_col).alias(P + "id"), rest.alias(P + "rest"))
    host = F.translate(F.regexp_extract(P + "rest", r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parsed = parsed.select(P + "id", host.alias(P + "host"), F.regexp_extract(P + "rest", r"^[^/?#]*([^?#]*)", 1).alias(P + "path"))
    subject = F.concat(P + "host", P + "path")
    tokens = F.array_distinct(F.regexp_extract_all(subject, F.lit(rf"({TOKEN})"), F.lit(1)))

    wanted = sorted({t for r in rules for t in r.tokens})
    known = F.filter(tokens, lambda t: t.isin(wanted)) if wanted else F.array().cast("array<string>")
    # One row per token of the rule list, however many pages there are.
    seen = {r[0]: r[1] for r in parsed.select(F.explode(known).alias("t")).groupBy("t").count().collect()}
    slots, always, size = _index(rules, seen)
    fetched = F.flatten(F.transform(P + "tokens", lambda t: F.filter(F.element_at(slots, (F.crc32(t) % size + 1).cast("int")), lambda e: e["t"] == t)))
    fits = F.filter(F.concat(fetched, always), lambda e: F.rlike(F.col(P + "subject"), e["pattern"]))
    best = F.array_max(F.transform(fits, lambda e: F.struct(e["priority"].alias("priority"), e["k"].alias("k"), e["rule"].alias("rule"), e["verdict"].alias("verdict"))))
    judged = parsed.withColumn(P + "tokens", tokens).withColumn(P + "subject", subject).withColumn(P + "best", best)
    return judged.select(
        F.col(P + "id").alias(id_col), F.col(P + "host").alias("host"), F.col(P + "path").alias("path"),
        F.col(P + "best")["rule"].alias("rule"), F.coalesce(F.col(P + "best")["verdict"], F.lit(default)).alias("verdict"),
    )


def _oracle() -> str:
    """The same verdicts without an index: every rule against every url."""
    sites = "\n".join(f"    UNION ALL SELECT {r.priority}, '{r.name}', '{r.verdict}', '{r.pattern}'" for r in SITE_RULES).replace("UNION ALL", "", 1)
    patterns = " OR ".join(f"regexp_matches(host || path, '{r.pattern}')" for r in PATTERN_RULES)
    return rf"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(priority, rule, verdict, pattern) AS ({sites}),
fit AS (SELECT page_id, arg_max(rule, priority) AS rule, arg_max(rules.verdict, priority) AS verdict
        FROM p JOIN rules ON regexp_matches(host || path, pattern) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, CASE WHEN {patterns} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit ON p.page_id = fit.page_id
"""


ORACLE = _oracle()
