import re

from pyspark.sql import functions as F

from quilldex.llm import urlfilter as U
from quilldex.llm.common import Work

SCHEMA = "page_id long, url string, html string"
URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/de/x?q#f", "https://a.net", "https://a.net/", "x://y://z/p", "http://example.net/en/", "http://sub.example.net/en/1", "http://notexample.net/en/1", "https://Ä.org/fr/", "http://u@h.org:80/fr/x?y", "http://h.org?x/fr/", "http://example.com/de", "http://a.b\nc/d\ne"]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def rule_of(host, path):
    best = None
    for verdict, h, p in U.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best


def test_hosts_paths_rules(spark):
    got = U.judge(spark.createDataFrame([(k, u, None) for k, u in enumerate(URLS)], SCHEMA).withColumns({"host": F.lit(1), "rule": F.lit(2), "of": F.lit(3)})).collect()
    for r in got:
        host, path = parse(URLS[r.page_id])
        assert (r.host, r.path) == (host, path), URLS[r.page_id]
        want = rule_of(host, path)
        assert r.rule == (want and want[0])
        assert r.verdict == want[1] if want else r.verdict in ("allow", "block")


def test_empty(spark):
    assert U.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_propagation_matches_a_plain_loop(spark):
    edges = [("a", "b", 2), ("b", "c", 1), ("a", "c", 1), ("c", "a", 3), ("d", "b", 1), ("e", "d", 5), ("d", "hub", 1), ("hub", "d", 1)]
    seeds = {"a": (1.0, 0.0), "b": (0.0, 1.0), "hub": (0.25, 0.5)}
    got = {r.host: (r.trust, r.distrust) for r in U.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame([(h, *v) for h, v in seeds.items()], "host string, trust double, distrust double"), Work(spark, "t"), tolerance=0.05).collect()}
    nodes = {x for e in edges for x in e[:2]}
    plain, sent = {}, {}
    for kind in (0, 1):
        for x in nodes:
            plain[kind, x] = sent[kind, x] = seeds.get(x, (0, 0))[kind]
    while True:
        before, sent = sent, {}
        for kind in (0, 1):
            links = [(s, d, n) if kind == 0 else (d, s, n) for s, d, n in edges]
            total = {x: sum(n for s, _, n in links if s == x) for x in nodes}
            for x in nodes:
                sent[kind, x] = 0.85 * sum(before[kind, s] * n / total[s] for s, d, n in links if d == x)
        if max(sent.values()) <= 0.05:
            break
        plain = {key: plain[key] + sent[key] for key in plain}
    for kind, x in plain:
        assert abs(got.get(x, (0, 0))[kind] - plain[kind, x]) < 1e-9


def test_links_to_blocked_hosts_are_suspect(spark):
    page = lambda k, host, to: (k, f"http://{host}/p{k}", "".join(f'<a href="https://{t}/x">' for t in to))
    rows = [page(1, "bad.net", []), page(2, "spam.test", ["bad.net"]), page(3, "fine.test", ["good.test"]), page(4, "good.test", []), (5, "http://spam.test/q", None)]
    got = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block"}


def test_links_of_all_kinds_as_in_sql(spark):
    import duckdb
    import pandas as pd

    html = ['<a href="//Bad.NET/x">', "<a href='https://bad.net'>", "<a HREF = //good.org>", '<base href="http://far.test/d/"><a href="e">', '<a href="/own"><a href="mailto:x@y">', None, '<a href="//bad.net"><a href="http://bad.net/2">']
    rows = [(k, f"http://h{k}.test/", h) for k, h in enumerate(html)] + [(90, "http://bad.net/", ""), (91, "http://good.org/fr/", ""), (92, "http://far.test/", '<a href="//bad.net/">'), (93, "//no.scheme/", '<a href="//bad.net/">')]
    pages = spark.createDataFrame(rows, SCHEMA)
    edges = {(r.src, r.dst, r.n) for r in U.host_edges(U.with_rules(pages)).collect()}
    assert edges == {("h0.test", "bad.net", 1), ("h1.test", "bad.net", 1), ("h2.test", "good.org", 1), ("h3.test", "far.test", 1), ("h6.test", "bad.net", 1), ("far.test", "bad.net", 1)}
    db = duckdb.connect()
    db.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    want = sorted(map(str, db.sql(U.oracle()).fetchall()))
    got = U.judge(pages).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(str(tuple(r)) for r in got) == want
