import random
import re

from geoloom.llm.urls import LISTED, RULES, frames, judge


def brute(url, rules, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p)
    won = max(((len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if fits(h, p)), default=None)
    on = any(fits(h, p) for h, p in listed)
    return host, path, won and won[3], won[4] if won else "block" if on else "allow", on


def test_like_brute_force(spark):
    rnd = random.Random(4)
    hosts = ["a.org", "org", "EXAMPLE.org", "m.example.org", "x.com", "com", "notcom", "b.net", "xorg", "adult-x.example.com", "", "org.", "é.org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/de/", "/fr/a#b", "/de/", "?q", "#f", "//", "/a\nb"]
    urls = [None, "", "no scheme", "://", "a://b://c.org/x"] + [f"http://{rnd.choice(hosts)}{rnd.choice(paths)}" for _ in range(200)]
    rows = [(i, u, "x", "y", "z") for i, u in enumerate(urls + urls[:3])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string, key string")
    rules = RULES + (("block", "b.net", "/"), ("allow", "b.net", "/"), ("allow", "a.org", "/de/"), ("block", "org", "/de/a"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.listed) for r in judge(pages, *frames(spark, rules, LISTED)).collect()}
    assert got == {i: brute(u, rules, LISTED) for i, u, *_ in rows}


def test_empty(spark):
    r, x = frames(spark)
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert judge(pages.limit(0), r, x).count() == 0
    (got,) = judge(pages, r.limit(0), x.limit(0)).collect()
    assert (got.rule, got.verdict) == (None, "allow")


def test_lists_with_paths_of_many_lengths(spark):
    rnd = random.Random(8)
    label = lambda: rnd.choice(["a", "b", "cc", "news", "org", "net"])
    host = lambda: ".".join(label() for _ in range(rnd.randrange(1, 5)))
    path = lambda n: "/" + "".join(rnd.choice("ab/é%") for _ in range(rnd.randrange(n)))
    rules = sorted({(rnd.choice(["allow", "block"]), host(), path(9)) for _ in range(150)})
    listed = sorted({(host(), path(40)) for _ in range(150)})
    urls = [f"https://{host()}{path(30)}?q={path(9)}" for _ in range(400)] + ["https://news.org/" + "a" * 100_000, "x://" + "a." * 500 + "org/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.listed) for r in judge(pages, *frames(spark, rules, listed)).collect()}
    assert got == {i: brute(u, rules, listed) for i, u in enumerate(urls)}
    assert len({x[2] for x in got.values()}) > 10
