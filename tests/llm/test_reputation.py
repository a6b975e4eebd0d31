"""Host reputation: hosts and paths, rules, shrinkage against a twin in plain Python, and odd rows."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from foldline.llm.host_reputation import judge_urls, reputations

PAGES = "page_id long, url string"
OUTCOMES = "page_id long, bad int"
RULES = "host string, path string, verdict string"


def split_url(url):
    """Host and path, letter by letter."""
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    path = rest[n:]
    return host, path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]


def slow_reputations(pages, outcomes, doubles):
    n, bad = Counter(), Counter()
    for page, b in outcomes:
        if b is not None and page is not None:
            for p, url in pages:
                if p == page:
                    n[split_url(url)[0]] += 1
                    bad[split_url(url)[0]] += b
    level = {}
    for host in {split_url(u)[0] for _, u in pages}:
        bare = host
        if ":" in host and (host.rsplit(":", 1)[1] == "" or host.rsplit(":", 1)[1].isdigit()):
            bare = host.rsplit(":", 1)[0]
        labels = bare.split(".")
        k = 2 if len(labels) >= 2 and ".".join(labels[-2:]) in doubles else 1
        level[host] = (".".join(labels[-k:]), ".".join(labels[-k - 1 :]))

    def shrink(groups):
        v = sum(p * (1 - p) for c, _, p in groups.values() if c)
        s = sum(c * (b / c - p) ** 2 for c, b, p in groups.values() if c)
        d = sum(p * (1 - p) * (c - 1) for c, _, p in groups.values() if c)
        rho = min(max((s - v) / d if d else 0.5, 0.001), 0.5)
        m = 1 / rho - 1
        return {g: ((p * m + b) / (m + c), m + c) for g, (c, b, p) in groups.items()}

    def summed(key):
        out = defaultdict(lambda: [0, 0])
        for h in level:
            out[key(h)][0] += n[h]
            out[key(h)][1] += bad[h]
        return out

    overall = (sum(bad.values()) + 1) / (sum(n.values()) + 2)
    suffix = shrink({g: (*c, overall) for g, c in summed(lambda h: level[h][0]).items()})
    domain = shrink({g: (*c, suffix[g[0]][0]) for g, c in summed(lambda h: level[h]).items()})
    host = shrink({h: (n[h], bad[h], domain[level[h]][0]) for h in level})
    return {h: (mean, (mean * (1 - mean) / (mass + 1)) ** 0.5) for h, (mean, mass) in host.items()}


URLS = [
    "http://A.Example.com/x?q#f", "https://a.example.com:8080/y", "ftp://b.example.com", "http://c.other.org?x=/no", "http://c.other.org#t", "http://d.shop.co.uk/p",
    "http://shop.co.uk/", "http://single/", "http://10.0.0.7/a", "no scheme", None, "", "://", "http://é.example.net/ä", "x://y://z/p", "http://never.seen.dev/",
]


@pytest.fixture(scope="module")
def small():
    pages = [(i, URLS[i % len(URLS)]) for i in range(3 * len(URLS))] + [(0, URLS[0]), (None, URLS[0]), (None, None)]
    outcomes = [(i, (i * 7 % 5 < 2) * 1) for i in range(0, 40) if i % len(URLS) != 15] + [(0, 1), (3, None), (None, 1), (999, 1)]
    return pages, outcomes


def test_reputations_equal_the_twin(spark, small):
    pages, outcomes = small
    want = slow_reputations(pages, outcomes, {"co.uk"})
    got = {r["host"]: (r["mean"], r["sd"]) for r in reputations(spark.createDataFrame(pages, PAGES), spark.createDataFrame(outcomes, OUTCOMES), ["co.uk"]).collect()}
    assert got.keys() == want.keys()
    for h in want:
        assert got[h] == pytest.approx(want[h], abs=1e-9), h


def test_hosts_paths_and_every_row(spark, small):
    pages, outcomes = small
    out = judge_urls(spark.createDataFrame(pages, PAGES), spark.createDataFrame(outcomes, OUTCOMES), spark.createDataFrame([], RULES)).collect()
    want = Counter((p, *split_url(u)) for p, u in pages)
    assert Counter((r["page_id"], r["host"], r["path"]) for r in out) == want
    assert all(r["rule"] is None and r["verdict"] in ("allow", "block") for r in out)


def test_longest_rule_and_ties(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/", "block"), ("a.example.net", "/", "allow"), ("co", "/x", "block")]
    urls = ["http://q.net/", "http://example.net/en/1", "http://example.net/EN/1", "http://a.example.net/en/", "http://a.example.net/", "http://notnet/", "http://net", "http://NET/", "http://x.co/xy", "http://x.co.net.org/"]
    want = [("net/", "block"), ("example.net/en/", "allow"), ("net/", "block"), ("example.net/en/", "allow"), ("a.example.net/", "allow"), (None, "allow"), (None, "allow"), ("net/", "block"), ("co/x", "block"), (None, "allow")]
    none = spark.createDataFrame([], OUTCOMES)
    out = judge_urls(spark.createDataFrame(list(enumerate(urls)), PAGES), none, spark.createDataFrame(rules, RULES)).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in out] == [(r, v) for r, v in want]
    assert all(r["bad_rate"] == 0.5 for r in out)  # no outcome at all


def test_many_bad_outcomes_block_a_host_and_few_do_not(spark):
    pages = [(i, "http://bad.site.com/") for i in range(200)] + [(1000 + i, f"http://h{i % 20}.fine{i % 50}.com/") for i in range(400)] + [(5000, "http://one.lone.com/")]
    outcomes = [(i, 1) for i in range(200)] + [(1000 + i, 0) for i in range(400)] + [(5000, 1)]
    out = judge_urls(spark.createDataFrame(pages, PAGES), spark.createDataFrame(outcomes, OUTCOMES), spark.createDataFrame([], RULES)).collect()
    assert {r["verdict"] for r in out if r["host"] == "bad.site.com"} == {"block"}
    assert {r["verdict"] for r in out if ".fine" in r["host"]} == {"allow"}


def test_empty_tables_and_clashing_columns(spark, small):
    pages, outcomes = small
    empty = judge_urls(spark.createDataFrame([], PAGES), spark.createDataFrame(outcomes, OUTCOMES), spark.createDataFrame([("net", "/", "block")], RULES))
    assert empty.collect() == []
    wide = spark.createDataFrame([(i, u, "h", "d", "r", 1, "v", 0.5) for i, u in pages], PAGES + ", host string, domain string, rule string, n int, verdict string, mean double")
    plain = judge_urls(spark.createDataFrame(pages, PAGES), spark.createDataFrame(outcomes, OUTCOMES), spark.createDataFrame([], RULES))
    other = judge_urls(wide, spark.createDataFrame(outcomes, OUTCOMES).selectExpr("*", "'x' AS host", "1 AS n"), spark.createDataFrame([], RULES))
    assert other.columns == plain.columns and Counter(map(tuple, other.collect())) == Counter(map(tuple, plain.collect()))
