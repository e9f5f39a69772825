import random
import re
from collections import Counter

import pytest

from tallyspark.llm.url_filter import judge_urls, propagate


def run(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r for r in judge_urls(frame).collect()}


def test_rules_and_parts(spark):
    rows = [
        (1, "http://A.Example.COM/en/7?x=1#y", None), (2, "https://x.com/en/70", ""), (3, "http://example.com/en/6", ""), (4, "http://notcom/en/7", ""),
        (5, "https://example.net/de/81", ""), (6, "https://example.net/de/9", ""), (7, "http://q.org?es/", ""), (8, None, None), (9, "no scheme", "h"), (10, "x://com/en/a://b/c", ""),
        (11, "http://example.com#/en/7", ""),
    ]
    got = run(spark, rows)
    rule = {i: (r.host, r.path, r.rule, r.verdict if r.rule else None) for i, r in got.items()}
    assert rule[1] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert rule[2] == ("x.com", "/en/70", "com/en/", "block")
    assert rule[3] == ("example.com", "/en/6", "com/en/", "block")
    assert rule[4] == ("notcom", "/en/7", None, None)
    assert rule[5][2:] == ("example.net/de/8", "block") and rule[6][2:] == ("net/de/", "block")
    assert rule[7] == ("q.org", "", None, None)
    assert rule[8][:3] == rule[9][:3] == ("", "", None) and got[8].verdict == "allow"
    assert rule[10] == ("com", "/en/a://b/c", "com/en/", "block")
    assert rule[11] == ("example.com", "", None, None)


def brute(edges, seeds, mean=False, damping=0.85, rounds=400):
    """Ranks along edges (a, b), dealt among the targets of a, or with `mean` the mean over the sources of b."""
    degree = Counter(b if mean else a for a, b in edges)
    rank = dict(seeds)
    for _ in range(rounds):
        new = dict(seeds)
        for a, b in edges:
            if a in rank:
                new[b] = new.get(b, 0) + damping * rank[a] / degree[b if mean else a]
        rank = new
    return rank


def test_propagation(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "f")]
    seeds = [("a", 1.0), ("d", 0.5)]
    frames = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "host string, weight double")
    for share_of in ("src", "dst"):
        got = propagate(*frames, share_of=share_of, tolerance=1e-4)
        assert {r.host: r.rank for r in got.collect()} == pytest.approx(brute(edges, seeds, share_of == "dst"), rel=1e-3)


def test_verdicts_against_brute_force(spark):
    """A hub that many hosts link to, hosts that link to it alone, and random links; repeated rows and null ids too."""
    rng = random.Random(4)
    hosts = [f"h{i}.{rng.choice(['com', 'net', 'org', 'io'])}" for i in range(40)] + ["hub.com"]
    rows = []
    for i in range(400):
        host = rng.choice(hosts)
        near = ["hub.com"] if hosts.index(host) % 3 == 0 else rng.sample(hosts, rng.randint(0, 3))
        html = "".join(f'<a HREF="//{x}/p">x</a>' for x in near)
        path = rng.choice(["/en/1", "/de/8", "/es/2", "/fr/3", "/en/7"]) if host != "hub.com" else "/en/9"
        rows.append((rng.choice([i, None, 7]), f"http://{host}{path}", html))
    rows += [rows[0], (900, "http://hub.com/fr/", ""), (901, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(frame).collect())

    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    pages, edges = [], set()
    for page, url, html in rows:
        host, path = re.match(r"http://([^/]*)(.*)", url).groups() if url else ("", "")
        fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        pages.append((page, host, path, max(fit, key=lambda r: len(r[1] + r[2]), default=None)))
        edges |= {(host, x) for x in re.findall(r'HREF="//([^/]*)', html or "") if x != host}
    share = {v: {h: sum(1 for p in pages if p[1] == h and p[3] and p[3][0] == v) / sum(p[1] == h for p in pages) for h in {p[1] for p in pages}} for v in ("allow", "block")}
    trust = brute(sorted(edges), [(h, w) for h, w in share["allow"].items() if w])
    distrust = brute(sorted((b, a) for a, b in edges), [(h, w) for h, w in share["block"].items() if w], mean=True)
    want = Counter()
    for page, host, path, rule in pages:
        bad = distrust.get(host, 0)
        verdict = rule[0] if rule else "block" if bad > 0.5 and bad > trust.get(host, 0) else "allow"
        want[(page, host, path, rule and rule[1] + rule[2], verdict)] += 1
    assert got == want
    assert {v for *_, r, v in got if r is None} == {"allow", "block"}


def test_pages_follow_their_host(spark):
    bad = '<a href="http://bad.com/en/1">x</a>'
    rows = [(1, "http://bad.com/en/1", ""), (2, "http://bad.com/fr/1", ""), (3, "http://bad.com/en/2", ""), (4, "http://friend.io/x", bad), (5, "http://other.io/", "<a href=/local>y</a>")]
    got = run(spark, rows)
    assert got[2].verdict == "block" and got[4].verdict == "block" and got[5].verdict == "allow"
    assert judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_words_of_the_contract(spark):
    """Pages of net/de/ are allowed but under example.net/de/8, and their host is trusted."""
    rows = [(1, "https://a.net/de/1", ""), (2, "https://example.net/de/9", ""), (3, "https://example.net/de/81", ""), (4, "https://a.net/fr/1", "")]
    got = run(spark, rows)
    assert [(got[i].rule, got[i].verdict) for i in (1, 2, 3)] == [("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block")]
    assert got[4].rule is None and got[4].verdict == "allow" and got[4].trust > 0 and got[4].distrust == 0
