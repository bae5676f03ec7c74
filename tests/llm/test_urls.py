"""URL rules against trying every rule on every URL."""

import itertools

from recordflow.llm import urls

RULES = [("com", "/en/", "block"), ("Example.com", "/en/7", "allow"), ("net", "/de/", "allow"),
         ("example.net", "/de/8", "block"), ("org", "", "block"), ("x.org", "", "allow"),
         ("org", "/same", "allow"), ("org", "/same", "block"), (None, "/", "block"), ("", "/root", "block")]
URLS = [None, "", "no scheme", "http://", "https://a.example.com/en/71?q#f", "x://EXAMPLE.com/en/6",
        "http://example.com/EN/7", "http://com/en/", "http://xcom/en/", "http://b.net/de/8",
        "http://a.b.example.net/de/8#x", "http://x.org", "http://y.x.org/same", "http://z.org/same/1",
        "http://org?a=/en/", "http://..com//en/", "a://b://c.com/en/", "http:///root/x",
        "http://" + "a." * 300 + "com/en/" + "p" * 3000, "http://é.com/en/ü", "http://a.com\n/en/"]


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    stop = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:stop])
    path = rest[stop:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), v == "block", h + p, v)
            for h, p, v in ((h.lower(), p, v) for h, p, v in rules if h is not None)
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_against_brute_force(spark):
    rows = [(i, u, "old", "old") for i, u in enumerate(URLS + URLS)]
    pages = spark.createDataFrame(rows, "page_id int, url string, rule string, html string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules).collect()}
    for (i, u, _, _), (mine, want) in zip(rows, ((got[i], brute(u, RULES)) for i, u, *_ in rows)):
        assert mine == want, u
    assert len(got) == len(rows)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, URLS[4])], "page_id int, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [(r.rule, r.verdict) for r in urls.judge(pages, none, default="block").collect()] == [
        (None, "block")]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert urls.judge(pages.limit(0), rules).count() == 0


def test_random_urls(spark):
    hosts = ["a.com", "b.a.com", "com", "b.com", "a.b.a.com"]
    paths = ["", "/", "/x", "/x/y", "/xx"]
    every = [f"h://{h}{p}{e}" for h, p, e in itertools.product(hosts, paths, ["", "?x", "#/x"])]
    rules = [(h, p, v) for (h, p), v in zip(itertools.product(hosts[:4], paths[1:4]),
                                            itertools.cycle(["block", "allow", "block"]))]
    pages = spark.createDataFrame(list(enumerate(every)), "page_id int, url string")
    df = urls.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    for r in df.collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, rules)
