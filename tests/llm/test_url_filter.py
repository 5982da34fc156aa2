import random
import re

from lumenflow.llm import url_filter as U

FIXED = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), h + p, v) for v, h, p in FIXED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if any(re.search(r.pattern, host + path) for r in U.PATTERN_RULES) else "allow"


def test_every_rule_against_every_url(spark):
    rng = random.Random(2)
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "a.www.example.com", "net", "x.net", "xnet", "spam-farm.org", "cheap-pills.io", "user@h.net:80", "", "com", "ÀB.net"]
    paths = ["", "/", "/en/", "/en", "/es/1", "/fr/", "/EN/", "/casino/x", "/es?/es/", "#/fr/", "?q=://x.net/es/", "/adult/1", "/en//", "/a.torrent"]
    urls = [f"{s}{h}{p}" for s in ("http://", "://", "ftp://", "", "x://y://") for h in hosts for p in paths] + [None, "", "://", "no url at all", "http:/x.net/es/"]
    urls += ["".join(rng.choice("ab.:/?#netcom") for _ in range(30)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.url_filter(df).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert got[i] == brute(u), u


def test_tokens_stand_whole_in_what_rules_fit():
    assert U.site_rule("block", "a.b", "/x/y").tokens == ("a", "b", "x")
    assert U.site_rule("block", "a.b", "/x/").tokens == ("a", "b", "x")


def test_tokens_of_patterns():
    need = U.required_tokens
    assert need(r"\bspam\b") == ("spam",) and need(r"spam") == () and need(r"/a/bc?/d/") == ("a", "d")
    assert need(r"\b(?:cheap|online)-pills\b") == ("pills",) and need(r"/x/|\bx\.") == ("x",) and need(r"/x/|/y/") == ()
    assert need(r"(?i)/x/") == () and need(r"(?:/x/)?/y/") == ("y",) and need(r"(?:/x/)+") == ("x",)
    assert all(r.tokens for r in U.PATTERN_RULES)
    assert U.url_filter  # each rule alone, below


def test_each_pattern_rule_alone(spark):
    words = ["spam", "link-farm", "cheap-pills", "cheap-meds", "online-pills", "casino", "poker", "porn", "xxx", "adult", "warez", "torrent", "free-gift", "freegift"]
    urls = [f"http://{a}{w}{b}" for w in words for a in ("", "x.", "a.org/", "a.org/q/", "my-") for b in ("", ".com", "/", "s", "-x")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").cache()
    for rule in U.PATTERN_RULES:
        got = {r["page_id"]: r["verdict"] for r in U.url_filter(df, rules=(rule,)).collect()}
        assert got == {i: "block" if re.search(rule.pattern, u[7:]) else "allow" for i, u in enumerate(urls)}


def test_thousands_of_random_rules(spark):
    """Every rule against every url, for rules read from a table."""
    rng = random.Random(9)
    label = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 3)))
    rows = [(rng.choice(["allow", "block"]), ".".join(label() for _ in range(rng.randint(1, 3))), "/" + "/".join(label() for _ in range(rng.randint(0, 2)))) for _ in range(3000)]
    rules = U.rules_of(spark.createDataFrame(rows, "verdict string, host string, path string"))
    urls = ["http://" + ".".join(label() for _ in range(rng.randint(1, 4))) + "/" + "/".join(label() for _ in range(rng.randint(0, 3))) for _ in range(400)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).collect()}
    for i, u in enumerate(urls):
        host, _, path = u[7:].partition("/")
        fits = [(len(r.name), -k, r.name, r.verdict) for k, r in enumerate(rules) for h, _, p in [r.name.partition("/")] if (host == h or host.endswith("." + h)) and ("/" + path).startswith("/" + p)]
        assert got[i] == (max(fits)[2:] if fits else (None, "allow")), u


def test_no_rows_rules_or_tokens(spark):
    df = spark.createDataFrame([(None, "http://x.net/es/", "h", "r")], "page_id long, url string, host string, rule string")
    assert U.url_filter(df.limit(0)).count() == 0
    assert U.url_filter(df, rules=()).first()["verdict"] == "allow"
    bare = U.Rule("any", "es", (), "block", 5)
    assert U.url_filter(df, rules=(bare,)).first()["rule"] == "any"
    assert U.url_filter(df.unionByName(df)).count() == 2
