"""Hosts, paths and rules against Python; propagated trust against numpy."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import urls


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    rest, host = rest[host:], rest[:host]
    path = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:path]


def rule(host, path):
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


FIXED = [
    "http://www.Example.COM/en/1?x#y", "http://example.com/en/", "http://com/x", "https://a.net/es/1", "a.net/es/1", "x://a://b/c", "http://example.com", "http://notexample.com/en/",
    "http://ÄB.net/fr/\n/x", "http://h?q=://z/", "://", "http://user:p@a.net:80/fr/", None, "",
]


def check(spark, given_urls):
    rows = [(k, u, None) for k, u in enumerate(given_urls)]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, u, _ in rows:
        host, path = split(u)
        assert (got[k]["host"], got[k]["path"]) == (host, path), u
        want, verdict = rule(host, path)
        assert got[k]["rule"] == want
        assert got[k]["verdict"] == (verdict or got[k]["verdict"])


def test_fixed_urls(spark):
    check(spark, FIXED)


def test_many_urls(spark):
    made = []

    @settings(max_examples=200, deadline=None)
    @given(st.text(alphabet="aA.:/?#comnetfres ", max_size=24), st.sampled_from(["http://", "", "://"]))
    def collect(tail, head):
        made.append(head + tail)

    collect()
    check(spark, made)


def brute_rank(edges, seeds, damping=0.85):
    hosts = sorted({h for e in edges for h in e[:2]} | set(seeds))
    at = {h: k for k, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for a, b, w in edges:
        m[at[b], at[a]] += w
    m /= np.maximum(m.sum(axis=0), 1e-300)
    s = np.zeros(len(hosts))
    for h, w in seeds.items():
        s[at[h]] = w
    s /= s.sum()
    x = np.linalg.solve(np.eye(len(hosts)) - damping * m, (1 - damping) * s)
    return dict(zip(hosts, x))


def test_trust_and_distrust_spread(spark):
    link = lambda *to: "".join(f'<a class="x" href="{u}">t</a>' for u in to)
    rows = [
        (1, "http://good.com/a", link("http://friend.org/x", "//friend.org/y", "/local")), (2, "http://friend.org/z", link("https://pal.org/")), (3, "http://pal.org/", None),
        (4, "http://bad.net/es/1", None), (5, "http://spam.org/", link("http://bad.net/q", "http://bad.net/q")), (6, "http://ring.org/", link("http://spam.org/")),
        (7, "http://mixed.org/", link("http://bad.net/", "http://good.com/")), (8, "http://alone.org/", "<p>no link"), (8, "http://alone.org/", "<p>no link"), (None, "http://spam.org/b", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = urls.judge(df).collect()
    assert len(got) == len(rows)
    edges = [("good.com", "friend.org", 1), ("friend.org", "pal.org", 1), ("spam.org", "bad.net", 1), ("ring.org", "spam.org", 1), ("mixed.org", "bad.net", 1), ("mixed.org", "good.com", 1)]
    trust = brute_rank(edges, {"good.com": 1})
    distrust = brute_rank([(b, a, w) for a, b, w in edges], {"bad.net": 1})
    for r in got:
        t, d = trust.get(r["host"], 0), distrust.get(r["host"], 0)
        assert abs(r["host_distrust"] - (d / (t + d) if t + d else 0)) < 1e-6
        if r["rule"] is None:
            assert r["verdict"] == ("block" if t + d and d / (t + d) > 0.5 else "allow")
    verdicts = {r["host"]: r["verdict"] for r in got}
    assert verdicts["friend.org"] == verdicts["pal.org"] == verdicts["alone.org"] == "allow"
    assert verdicts["spam.org"] == verdicts["ring.org"] == "block"


def test_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_distrust_goes_down_a_chain_of_any_length(spark):
    """A host that leads to a blocked one over 120 others is distrusted too."""
    n = 120
    rows = [(k, f"http://h{k}.test/", f'<a href="http://h{k + 1}.test/">x</a>') for k in range(n)] + [(n, f"http://h{n}.test/", "")]
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules=[("block", f"h{n}.test", "/")])
    assert {r["verdict"] for r in out.collect()} == {"block"}


def test_ranks_are_the_solution_on_a_cycle(spark):
    n, d = 60, 0.85
    edges = spark.createDataFrame([(f"h{k}", f"h{(k + 1) % n}", 1.0) for k in range(n)], "a string, b string, w double")
    got = {r["host"]: r["rank"] for r in urls.spread(edges, spark.createDataFrame([("h0", 1.0)], "host string, weight double"), d, 1e-9).collect()}
    for k in range(n):
        assert abs(got[f"h{k}"] - (1 - d) * d**k / (1 - d**n)) < 1e-9
