"""Rules by brute force, propagation against a dense computation."""

import random
import re

import numpy as np
import pytest
from cohortspark.llm import url_filter as U

PAGE = "page_id long, url string, html string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def decide(host, path, rules):
    fits = [(-len(h + p), i, h + p, v) for i, (v, h, p) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return min(fits)[2:] if fits else (None, None)


def test_rules_match_brute_force(spark):
    rng = random.Random(1)
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "xexample.com", "net", "x.net", "planet", "org", "EXAMPLE.COM", "ÀB.net", "", "a..com", "com."]
    paths = ["", "/", "/en", "/en/", "/en/x", "/es/", "/fr/q/r", "/EN/", "/é"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{h}{p}{rng.choice(['', '?q=/en/', '#/es/', '?a#b'])}" for h in hosts for p in paths]
    urls += [None, "", "nohost", "a://b://c/en/", "x\n://exam\nple.net/es/\n"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(None, urls[5], ""), (3, urls[3], "")], PAGE)
    rules = U.RULES + [("block", "a.www.example.com", "/"), ("allow", "example.com", "/en/"), ("block", "x.net", "")]
    got = U.filter_urls(pages.selectExpr("*", "1 as host", "2 as rule", "3 as trust"), rules).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        url = urls[5] if r.page_id is None else urls[r.page_id]
        host, path = parts(url)
        rule, verdict = decide(host, path, rules)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_no_python_in_the_plan(spark):
    plan = U.op4_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


@pytest.mark.parametrize("seed", [1, 2])
def test_propagation_matches_a_dense_computation(spark, seed):
    rng = random.Random(seed)
    n = 12
    edges = {(a, b): float(rng.randrange(1, 5)) for a in range(n) for b in range(n) if a != b and rng.random() < 0.2}
    seeds = {0: 3.0, 5: 1.0}
    links = spark.createDataFrame([(f"h{a}", f"h{b}", w) for (a, b), w in edges.items()], "src string, dst string, n double")
    got = {r.host: r.rank for r in U.propagate(links, spark.createDataFrame([(f"h{h}", w) for h, w in seeds.items()], "host string, weight double"), rounds=6, tolerance=0).collect()}
    v = np.array([seeds.get(i, 0) for i in range(n)]) / 4
    out = np.zeros((n, n))
    for (a, b), w in edges.items():
        out[a, b] = w
    out = np.divide(out, out.sum(axis=1, keepdims=True), out=np.zeros_like(out), where=out.sum(axis=1, keepdims=True) > 0)
    rank = v
    for _ in range(6):
        moved = U.DAMPING * rank @ out
        rank = moved + v * (1 - moved.sum())
    assert np.allclose([got.get(f"h{i}", 0.0) for i in range(n)], rank, atol=1e-9)


def test_trust_and_distrust_reach_hosts_without_rules(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://a.com/x", '<a href="http://good.org/1">x</a><a href=//Good.org/2>'),
            (2, "http://good.org/", '<a href="/rel"><a href="http://good.org/self">'),
            (3, "http://bad.net/fr/", "x"),
            (4, "http://spam.org/q", '<a HREF = "https://bad.net/fr/1?z">y</a>'),
            (5, "http://spam2.org/q", "<a href='http://spam.org/'>"),
            (6, "http://bad.net/en/", "clean page of a host with blocked pages"),
            (7, "http://alone.org/", None),
        ],
        PAGE,
    )
    got = {r.page_id: r for r in U.filter_urls(pages, U.RULES).collect()}
    assert {i: r.verdict for i, r in got.items()} == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow"}
    assert got[2].trust > 0 and got[4].distrust > got[5].distrust > 0


def test_propagation_goes_on_to_the_tolerance(spark):
    """A chain of 40 hosts, and two that pass their rank to and fro."""
    links = [(f"h{i}", f"h{i + 1}", 1.0) for i in range(40)] + [("a", "b", 1.0), ("b", "a", 1.0)]
    seeds = spark.createDataFrame([("h0", 1.0), ("a", 3.0)], "host string, weight double")
    got = {r.host: r.rank for r in U.propagate(spark.createDataFrame(links, "src string, dst string, n double"), seeds).collect()}
    hosts = sorted({h for s, d, _ in links for h in (s, d)})
    at = {h: i for i, h in enumerate(hosts)}
    p, v = np.zeros((len(at), len(at))), np.zeros(len(at))
    for s, d, _ in links:
        p[at[s], at[d]] = 1
    v[at["h0"]], v[at["a"]] = 0.25, 0.75
    exact = np.linalg.solve(np.eye(len(at)) - U.DAMPING * p.T, v)
    exact /= exact.sum()
    assert got["h35"] > 0 and np.abs(np.array([got.get(h, 0.0) for h in hosts]) - exact).sum() < 2 * U.TOLERANCE * U.DAMPING / (1 - U.DAMPING)


def small_crawl(i=""):
    return [
        (f"http://a{i}.com/x", f'<a href="http://good{i}.org/1">x</a><a href="http://both{i}.org/">y</a>'),
        (f"http://good{i}.org/", ""),
        (f"http://bad{i}.net/fr/", ""),
        (f"http://spam{i}.org/q", f'<a href="http://bad{i}.net/fr/1">y</a>'),
        (f"http://spam2{i}.org/q", f"<a href='http://spam{i}.org/'>"),
        (f"http://both{i}.org/", f"<a href='http://bad{i}.net/'><a href='http://good{i}.org/'>"),
        (f"http://alone{i}.org/", None),
    ]


VERDICTS = ["allow", "allow", "block", "block", "block", "allow", "allow"]


def verdicts(spark, rows):
    pages = spark.createDataFrame([(n, *row) for n, row in enumerate(rows)], PAGE)
    return {rows[r.page_id][0]: r.verdict for r in U.filter_urls(pages, U.RULES).collect()}


def test_a_thousand_copies_of_a_graph_keep_its_verdicts(spark):
    assert list(dict(sorted(verdicts(spark, small_crawl()).items())).values()) == [v for _, v in sorted(zip([u for u, _ in small_crawl()], VERDICTS))]
    many = verdicts(spark, [row for i in range(1000) for row in small_crawl(f"-{i}")])
    assert many == {row[0]: v for i in range(1000) for row, v in zip(small_crawl(f"-{i}"), VERDICTS)}


def test_linkers_to_one_seed_beside_a_hot_seed_are_all_blocked(spark):
    linkers = [(f"http://linker{i}.org/", "<a href='http://bad.net/fr/'>") for i in range(9000)]
    hot = [(f"http://hot.net/fr/{i}", "") for i in range(9000)]
    got = verdicts(spark, small_crawl() + linkers + hot)
    assert {got[url] for url, _ in linkers} == {"block"} and got["http://spam.org/q"] == got["http://spam2.org/q"] == "block"
    assert got["http://good.org/"] == got["http://alone.org/"] == "allow"


def test_empty_tables_and_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.net/es/", "")], PAGE)
    assert U.filter_urls(pages.limit(0), U.RULES).collect() == []
    assert [r.verdict for r in U.filter_urls(pages, []).collect()] == ["allow"]
