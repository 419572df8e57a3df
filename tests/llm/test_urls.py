import random
import re

import numpy as np
import pytest

from segcast.llm import urls as U

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "page_id long, url string, html string"


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return host.translate(LOWER), path if url.split("://", 1)[1][len(host):len(host) + 1] == "/" else ""


def brute_rule(host, path, rules=U.RULES):
    fit = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def received(n, edges, start, damping=U.DAMPING):
    """Rank received: damping * M (start + received), solved densely."""
    m = np.zeros((n, n))
    for s, t, w in edges:
        m[t, s] += w
    m /= np.maximum(m.sum(axis=0), 1)
    return np.linalg.solve(np.eye(n) - damping * m, damping * m @ start)


def pagerank(n, edges, start, damping=U.DAMPING):
    """Textbook personalised PageRank: rank of hosts without links returns to the start vector."""
    m, p = np.zeros((n, n)), start / start.sum()
    for s, t, w in edges:
        m[t, s] += w
    m /= np.maximum(m.sum(axis=0), 1)
    x = p.copy()
    for _ in range(500):
        moved = m @ x
        x = damping * (moved + (1 - moved.sum()) * p) + (1 - damping) * p
    return x


def test_hosts_paths_and_rules_match_brute_force(spark):
    r = random.Random(1)
    hosts = ["net", "a.net", "Example.NET", "x.example.net", "badexample.net", "example.com", "m.Example.com", "org", "a.org", "aorg", "", "É.org"]
    rest = ["", "/", "/en/", "/en/1", "/en", "/de/x?y=/fr/", "/fr/#a", "?q=/en/", "#/en/", "//en/", "/EN/1", "/a://b/en/"]
    urls = [None, "", "no scheme", "://", "http:/x", "a://b://c/d"] + [f"{s}://{h}{p}" for s in ("http", "") for h in hosts for p in rest]
    urls += ["http://u:p@host:80/x", "http://" + "a" * 50_000 + "/" + "b" * 50_000]
    rows = [(i, u, r.choice([None, "", "<p>"])) for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("host", "path", "rule", "action", "links", "blocked"):
        df = df.withColumn(c, df.page_id)
    got = {x.page_id: x for x in U.judge_pages(df).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = brute_url(u)
        rule, action = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        if action:
            assert got[i].verdict == action


def link(h):
    return f'<a class=x HREF = "https://{h}/p?q">t</a>'


def graph(spark, n, pairs, seeds):
    e = spark.createDataFrame([(f"h{s}", f"h{t}", w) for s, t, w in pairs], "source string, target string, n long")
    q = spark.createDataFrame([(k, f"h{i}") for k, v in seeds.items() for i in v], "kind string, host string")
    return {(x.kind, x.host): x for x in U.propagate(e, q).collect()}


def test_propagation_matches_dense_pagerank(spark):
    r = random.Random(2)
    n, seeds, edges = 25, {"trust": [0, 1, 2], "distrust": [3, 4]}, {}
    for _ in range(90):
        s, t = r.randrange(n), r.randrange(n)
        if s != t:
            edges[s, t] = edges.get((s, t), 0) + r.randint(1, 3)
    edges = [(s, t, w) for (s, t), w in edges.items()]
    got = graph(spark, n, edges, seeds)
    for kind, way in (("trust", edges), ("distrust", [(t, s, w) for s, t, w in edges])):
        links, start = np.zeros(n), np.zeros(n)
        for s, _, w in way:
            links[s] += w
        start[seeds[kind]] = links[seeds[kind]]
        mine, everyone = received(n, way, start), received(n, way, links)
        whole = start + mine
        assert np.allclose(whole / whole.sum(), pagerank(n, way, start), atol=1e-9)  # the textbook's, but for the constant
        for i in range(n):
            x = got.get((kind, f"h{i}"))
            assert (x.seed_rank if x else 0.0) == pytest.approx(mine[i], rel=1e-4, abs=1e-9)
            assert (x.rank if x else 0.0) == pytest.approx(everyone[i], rel=1e-4, abs=1e-9)
            assert x is None or x.share == pytest.approx(mine[i] / everyone[i], abs=1e-5) and 0 <= x.share <= 1


def test_long_chains_settle_at_the_default_tolerance(spark):
    n = 60
    chain = [(i + 1, i, 1) for i in range(n - 1)]  # each links to the one before; 0 is blocked
    got = graph(spark, n, chain, {"distrust": [0]})
    start, links = np.zeros(n), np.array([1.0] * (n - 1) + [0.0])
    start[0] = 1
    back = [(t, s, w) for s, t, w in chain]
    mine, everyone = received(n, back, start), received(n, back, links)
    assert all(got["distrust", f"h{i}"].share == pytest.approx(mine[i] / everyone[i], abs=1e-5) for i in range(1, n))


def test_hosts_that_link_to_blocked_hosts_are_blocked(spark):
    rows = [(0, "http://spam.net/", ""), (1, "http://farm.info/", link("spam.net") * 3), (2, "http://good.example.net/en/", link("fine.info")),
            (3, "http://fine.info/x", link("FINE.info") + '<a href="/rel">'), (4, "http://alone.info/", None), (5, None, link("spam.net"))]
    got = {x.page_id: x for x in U.judge_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i].verdict for i in range(6)] == ["block", "block", "allow", "allow", "allow", "allow"]
    assert got[1].rule is None and got[1].host_distrust > 0 and got[3].host_trust > 0


def test_empty_repeated_and_no_seeds(spark):
    df = spark.createDataFrame([(1, "http://a.info/", link("b.info"))] * 2, SCHEMA)
    assert [x.verdict for x in U.judge_pages(df).collect()] == ["allow", "allow"]
    assert U.judge_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 20, 2000])
def test_every_linker_to_a_blocked_host_is_blocked(spark, k):
    """However many there are, beside one with many links, a sister host, a far larger farm and unrelated trust."""
    linkers = [(i, f"http://farm{i}.info/", link("spam.net")) for i in range(k)]
    others = [(-1, "http://spam.net/", ""), (-2, "http://many.info/", link("spam.net") * 500), (-3, "http://half.info/", link("spam.net") + link("sister.info")),
              (-4, "http://rare.info/", link("spam.net") + link("else.info") * 99), (-5, "http://far.info/", link("farm0.info")),
              (-6, "http://hub.net/", ""), (-7, "http://big.info/", link("hub.net") * 5000),
              (-8, "http://good.example.net/en/", link("praised.info")), (-9, "http://praised.info/", link("spam.net") + link("a.info") * 9)]
    got = {x.page_id: x for x in U.judge_pages(spark.createDataFrame(linkers + others, SCHEMA)).collect()}
    assert all(got[i].verdict == "block" and got[i].host_distrust == pytest.approx(1.0, abs=1e-5) for i in range(k))
    assert [got[-i].verdict for i in range(1, 10)] == ["block", "block", "block", "allow", "block", "block", "block", "allow", "allow"]
    assert got[-3].host_distrust == pytest.approx(0.5, abs=1e-5) and got[-4].host_distrust == pytest.approx(0.01, abs=1e-5)
    assert got[-5].host_distrust == pytest.approx(0.85 / 1.85, abs=1e-5)
