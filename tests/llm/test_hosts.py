import math

import pytest
from pyspark.sql import functions as F

from gatehouse.llm import hosts

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/es/", "allow"), ("b.c.org", "/x", "block")]
URLS = [
    "https://WWW.Example.com/en/1?x=/en/#y", "http://m.example.com/en/2", "http://example.com/fr/", "http://example.com", "http://anexample.com/en/1", "http://a.net/es/1", "http://net/es/", "http://a.net/ES/1", "http://b.c.org/xy", "http://a.b.c.org/x?",
    "http://c.org/x", "no scheme", None, "", "://", "http://", "http:///path", "a://b://c/d", "http://host?q=/p", "http://host#f/p", "http://ho\nst/a\nb?c", "http://ünï.org/ä", "http://u:p@h.org:80/p", "https://x.co.uk/", "https://y.x.co.uk/",
]


def plain_place(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[cut:]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]


def plain_rule(host, path):
    fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def plain_reputation(pages, bad, limit, z):
    """host -> (n, mean, bound) by the same formulas over dictionaries."""
    tally = {}
    for i, host in pages:
        t = tally.setdefault(host, [0, 0])
        if bad.get(i) is not None:
            t[0] += 1
            t[1] += bad[i]
    def parents(host):  # noqa: E306
        labels = host.split(".")
        n = 2 if ".".join(labels[-2:]) in hosts.SUFFIXES else 1
        return ".".join(labels[-n:]), ".".join(labels[-n - 1 :])
    def shrink(nodes):  # noqa: E306
        spread = sum((b - n * m) ** 2 - n * m * (1 - m) for n, b, m in nodes.values())
        room = sum(n * (n - 1) * m * (1 - m) for n, b, m in nodes.values())
        s = 1 / max(hosts.RHO[0], min(hosts.RHO[1], spread / room if room else hosts.RHO[0])) - 1
        return {k: (b + s * m) / (n + s) for k, (n, b, m) in nodes.items()}, s
    def level(of, prior):  # noqa: E306
        out = {}
        for host, (n, b) in tally.items():
            x = out.setdefault(of(host), [0, 0, prior(host)])
            x[0] += n
            x[1] += b
        return shrink(out)
    total = (sum(b for _, b in tally.values()) + 0.5) / (sum(n for n, _ in tally.values()) + 1)
    suffix, _ = level(lambda h: parents(h)[0], lambda h: total)
    domain, _ = level(lambda h: parents(h)[1], lambda h: suffix[parents(h)[0]])
    own, s = level(lambda h: h, lambda h: domain[parents(h)[1]])
    return {h: (tally[h][0], m, m - z * math.sqrt(m * (1 - m) / (tally[h][0] + s + 1))) for h, m in own.items()}


@pytest.fixture(scope="module")
def case(spark):
    urls = URLS + [f"https://h{k % 9}.d{k % 3}.org/p{k}" for k in range(300)] + [f"https://bad.d0.org/{k}" for k in range(60)]
    pages = list(enumerate(urls)) + [(3, URLS[3]), (None, "http://h1.d1.org/null")]
    bad = {k: int((k * 7919 % 10) < (8 if "bad.d0" in (u or "") else 2)) for k, u in enumerate(urls) if k % 4}
    labels = [(k, b) for k, b in bad.items()] + [(k, 0) for k in list(bad)[:20]] + [(None, 1), (10**9, 1), (0, None)]
    return pages, bad, spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("clash")), spark.createDataFrame(labels, "page_id long, bad int"), spark.createDataFrame(RULES, "host string, path string, verdict string")


@pytest.mark.parametrize("hot", [1, 30, 10**9])
def test_equals_plain_rules_and_reputation(spark, case, monkeypatch, hot):
    monkeypatch.setattr(hosts.common, "HOT", hot)
    pages, bad, df, labels, rules = case
    got = hosts.judge(df, labels, rules).collect()
    known = plain_reputation([(i, plain_place(u)[0]) for i, u in pages], bad, hosts.LIMIT, hosts.Z)
    want = []
    for i, u in pages:
        host, path = plain_place(u)
        rule, says = plain_rule(host, path)
        n, mean, bound = known[host]
        want.append((i, host, path, rule, says or ("block" if bound > hosts.LIMIT else "allow"), n, round(mean, 9), round(bound, 9)))
    assert sorted(map(str, ((*r[:6], round(r[6], 9), round(r[7], 9)) for r in got))) == sorted(map(str, want))
    assert {r["verdict"] for r in got if r["host"] == "bad.d0.org"} == {"block"} and {r["verdict"] for r in got if r["host"] == "h1.d1.org"} == {"allow"}


def test_a_few_bad_pages_do_not_block_an_unknown_host(spark):
    pages = spark.createDataFrame([(k, f"http://h{k % 40}.d{k % 8}.org/") for k in range(400)] + [(1000 + k, "http://new.one.org/") for k in range(2)], "page_id long, url string")
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(400)] + [(1000, 1), (1001, 1)], "page_id long, bad int")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    got = {r["host"]: r for r in hosts.judge(pages, labels, rules).collect()}
    assert got["new.one.org"]["verdict"] == "allow" and got["new.one.org"]["bad_mean"] > got["h1.d1.org"]["bad_mean"]
    assert {r["verdict"] for r in hosts.judge(pages, labels.where("false"), rules).collect()} == {"allow"}
    assert hosts.judge(pages.where("false"), labels, rules).count() == 0
