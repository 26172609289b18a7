from palimpsest.llm import url_filter as U

SCHEMA = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute(url, rules=U.RULES):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
        path = rest[cut:end] if cut < end else ""
    best = max(((len(r), r, v) for v, r in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)), default=None)
    return host, path, best and best[1], best and best[2]


URLS = ["http://a.example.org/es/1", "https://Example.ORG/en/12?x=/y#z", "http://x.com/fr/9", "http://x.com/de/1", "http://x.com/es/1", "no scheme", None, "", "http://", "http://org", "http://org/", "http://a.b/c://d/e", "ftp://u@example.org:80/en/1", "http://EXAMPLE.org?q", "http://notexample.org/es/", "http://x.com#/fr/", "http://é.com/de/ß\n2"]


def test_rules(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(pages(spark, [(i, u, None) for i, u in enumerate(URLS)])).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute(u)
        assert got[i] == (host, path, rule, verdict or "allow"), u


def test_decisions_reach_aliases(spark):
    link = lambda u: f'<html><head><link href="{u}" rel="canonical"></head></html>'
    go = lambda u: f'<meta content="0; url={u}" http-equiv=refresh>'
    rows = [
        (1, "http://a.net/1", link("http://b.net/2")), (2, "http://b.net/2", go("http://c.com/de/3")), (3, "http://x.net/", None),
        (4, "http://c.com/fr/ok", link("http://c.com/de/3")), (5, "http://d.net/p#top", None), (6, "http://D.net/p?utm_source=x", go("/q")), (7, "http://d.net/q", link("http://e.com/de/9")),
        (7, "http://d.net/q", link("http://e.com/de/9")), (8, "http://f.net/", go("//g.org/x")), (9, "http://f.net/?", None), (10, None, link("http://e.com/de/9")),
    ]
    got = sorted((r.page_id, r.verdict) for r in U.filter_urls(pages(spark, rows)).collect())
    # 1, 2 and 4 are one group: 4 is allowed by its own rule, and that allows the group.
    assert got == [(1, "allow"), (2, "allow"), (3, "allow"), (4, "allow"), (5, "block"), (6, "block"), (7, "block"), (7, "block"), (8, "allow"), (9, "allow"), (10, "allow")]


def test_given_links_and_blocks(spark):
    links = spark.createDataFrame([("http://n.net/1", "http://n.net/2"), ("http://n.net/2", "http://z.com/de/"), ("http://n.net/9", None)], "a string, b string")
    got = {r.page_id: r.verdict for r in U.filter_urls(pages(spark, [(1, "http://n.net/1", None), (2, "http://n.net/3", "")]).selectExpr("*", "'x' as host", "1 as root", "'y' as node"), links=links).collect()}
    assert got == {1: "block", 2: "allow"}
    assert U.filter_urls(pages(spark, [])).count() == 0
