import random

import numpy as np

from geoloom.llm.pages import BODY_PAGES, NEAR_SHARE, OPEN_PAGES, OPEN_SHARE, RUN, blocks, clean_group, extract, suffix_intervals

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var t="</p><article>no";</script></head><body class="has-sidebar">
<nav><ul><li>menu</ul></nav><!-- <p>gone</p> --><div class="ad">buy</div><article><header><h1>Head &amp;  line</h1></header><p><b>bold<br>next<br><p>para &#233;&nbsp;x
two<div class="share-buttons">share</div><aside>side</aside><p>a < b &lt;i&gt;</p><section id="comments"><p>I think</p></section><form><p>mail</p></form></article>
<footer>&copy; me</footer></body></html>"""


def test_blocks():
    assert blocks(PAGE) == (["Head & line", "bold next", "para é x two", "a < b <i>"], True)
    assert blocks(None) == ([], False) and blocks("") == ([], False)
    assert blocks("plain text") == (["plain text"], False)
    assert blocks("<article><p>cut of") == (["cut of"], True)
    assert blocks("<article><p>one</p><p>two <a hre") == (["one", "two"], True)
    assert blocks("<div>a<script>x</div><p>y") == (["a"], False)
    assert blocks("<div class=cookie-banner>no<p>no</div><div>yes</div>") == (["yes"], False)
    assert blocks("<article class='comment'>no</article><main>yes</main>") == (["yes"], True)
    assert blocks("<p>one <span class='ad'>buy</span> two<p>three <span class=share>x<p>four") == (["one two", "three", "four"], False)
    assert blocks("<div>top</div><div id=content><p>yes</p></div><div class=sidebar><div class=content>no</div></div>") == (["yes"], True)
    assert blocks("<div class=content><div>no</div><article>yes</article></div>") == (["yes"], True)
    assert blocks("<div class='menu wide'><article>yes</article></div><nav><article>no</article></nav>") == (["yes"], True)


def test_suffix_intervals():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 2, 200)
    got = suffix_intervals(ids, 5)
    for a in range(195):
        for b in range(195):
            assert (got[a] == got[b]) == (ids[a : a + 5] == ids[b : b + 5]).all()


def test_boilerplate():
    boiler = " ".join(f"b{i}" for i in range(RUN))
    pages = [[f"own{i} words{i} here{i}", boiler + f" tail{i}", boiler] for i in range(12)]
    assert clean_group(pages, [False] * 12) == [[f"own{i} words{i} here{i}", f"tail{i}"] for i in range(12)]
    assert clean_group(pages, [True] * 12) == [[f"own{i} words{i} here{i}", f"tail{i}"] for i in range(12)]
    # In a body, what fewer than half of the pages or too few pages share stays.
    few = pages[:5] + [[f"own{i} words{i} here{i}"] for i in range(20)]
    assert clean_group(few, [True] * 25) == few
    assert clean_group(pages[:9], [True] * 9) == pages[:9]
    # Copies count once.
    assert clean_group([pages[0]] * 30, [False] * 30) == [pages[0]] * 30


def test_frame(spark):
    rows = [(i, f"http://h.org/{i}", PAGE, "x", 1) for i in range(5)] + [(9, None, None, "x", 1), (9, "no", "", "x", 1), (None, "http://h.org/", PAGE, "x", 1)]
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string, shard int")).collect()
    assert len(out) == 8
    assert sum(r.text == "Head & line\n\nbold next\n\npara é x two\n\na < b <i>" for r in out) == 6
    assert all(r.n_chars == len(r.text) for r in out)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_runs_are_counted_over_the_host(spark):
    foot = " ".join(f"f{i}" for i in range(RUN))
    page = lambda i, last: "<div>" + " ".join(f"own{i}x{j}" for j in range(9)) + f"</div><div>{last}</div>"
    # 258 pages with one footer, and 1,500 of which few share one.
    rows = [(i, f"http://a.org/{i}", page(i, foot)) for i in range(258)]
    rows += [(1000 + i, f"http://b.org/{i}", page(1000 + i, foot if i % 500 == 0 else f"tail{i}")) for i in range(1500)]
    rows += [(5000 + i, f"http://c.org/{i}", page(5000 + i, foot)) for i in range(2)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert {i for i, t in got.items() if foot in t} == {5000, 5001}


def test_blocks_do_not_matter(spark):
    boiler = " ".join(f"b{i}" for i in range(RUN))
    tag = lambda i: ("article", "div")[i % 2]
    html = [f"<{tag(i)}><p>own{i} words{i}</p><p>{boiler if i % 3 else 'x'} tail{i}</p></{tag(i)}>" for i in range(40)]
    html += html[:5] + [None, ""]
    d = spark.createDataFrame([(i, f"http://h.org/{i}", x) for i, x in enumerate(html)], "page_id long, url string, html string")
    parsed = [blocks(x) for x in html]
    want = {i: "\n\n".join(t) for i, t in enumerate(clean_group([t for t, _ in parsed], [b for _, b in parsed]))}
    for n in (1, 7, 256):
        assert {r.page_id: r.text for r in extract(d, n).collect()} == want


def test_near_copies_of_an_article_stay():
    article = [f"a{j}" for j in range(100)]
    copies = [[" ".join(article[: 7 * i] + [f"new{i}"] + article[7 * i + 1 :])] for i in range(12)]
    assert clean_group(copies, [True] * 12) == copies
    # Beside other pages too, and a notice in bodies of their own still goes.
    boiler = " ".join(f"b{i}" for i in range(RUN))
    own = [[" ".join(f"own{i}x{j}" for j in range(30)), boiler] for i in range(12)]
    assert clean_group(copies + own[:11], [True] * 23) == copies + own[:11]
    assert clean_group(copies + own, [True] * 24) == copies + [x[:1] for x in own]


def test_attributes():
    """Quotes that don't pair belong to the tag, never to the text."""
    assert blocks("<article><p title='it's'>Hello</p><p>It's fine</p></article>") == (["Hello", "It's fine"], True)
    assert blocks('<article><p title="5" tall">Hello</p><p>more</p></article>') == (["Hello", "more"], True)
    assert blocks('<article><p class="x>Hello</p><p class="y">more</p></article>') == (["Hello", "more"], True)
    assert blocks('<article><p class="x>Hello</p></article>') == (["Hello"], True)
    assert blocks('<article><p title="a > b" data-x=1/2>Hello</p></article>') == (["Hello"], True)


def test_names_inside_a_body():
    prose = "The soup of the day is made of roots and herbs that grow behind the old house by the river"
    page = f'<main><h2 id="search-for-meaning">Search for meaning</h2><div class="menu"><p>{prose}</p></div><div class="related-work"><p>Others found it too</p></div></main>'
    assert blocks(page) == (["Search for meaning", prose, "Others found it too"], True)
    assert blocks(f'<article><p>{prose}</p><section id="reviews"><p>I liked it</p></section><div class="comment-list"><p>{prose}</p></div></article>') == ([prose], True)
    links = "<a href=/a>one of the links</a> <a href=/b>two of the links</a> <a href=/c>three of the links here</a>"
    assert blocks(f'<article><p>{prose}</p><div class="related-posts"><p>see {links}</p></div><div class="share">Share it</div><p class="alert">stays</p></article>') == ([prose, "stays"], True)


def plain_clean(pages, body):
    """Every run of RUN words with the distinct pages that hold it, by zone."""
    words = [[w for b in t for w in b.split()] for t in pages]
    runs = [[tuple(w[i : i + RUN]) for i in range(len(w) - RUN + 1)] for w in words]
    held, zone = {}, {True: set(), False: set()}
    for t, z, found in zip(pages, body, runs, strict=True):
        if t:
            zone[z].add(tuple(t))
        for r in found:
            held.setdefault((z, r), set()).add(tuple(t))
    least = {z: max(BODY_PAGES, (len(zone[z]) + 1) // 2) if z else OPEN_PAGES for z in zone}
    bad = [[i for i, r in enumerate(found) if len(held[z, r]) >= least[z]] for z, found in zip(body, runs, strict=True)]
    near = {}
    for t, z, found, b in zip(pages, body, runs, bad, strict=True):
        for r in found if z and b else ():
            near.setdefault(r, set()).add(tuple(t))
    out = []
    for t, z, w, found, b in zip(pages, body, words, runs, bad, strict=True):
        alike = sum(len(near.get(r, ())) >= OPEN_PAGES for r in found) if z else len(b)
        gone = {i + k for i in b for k in range(RUN)} if found and alike / len(found) <= (NEAR_SHARE if z else OPEN_SHARE) else set()
        kept, at = [], 0
        for b in t:
            n = len(b.split())
            kept.append(" ".join(x for k, x in enumerate(b.split(), at) if k not in gone))
            at += n
        out.append([b for b in kept if b])
    return out


def test_whole_hosts_against_a_plain_version(spark):
    rnd = random.Random(5)
    shared = {share: " ".join(f"s{share}x{j}" for j in range(12)) for share in (1, 2, 5, 30, 49, 50, 51, 80)}
    rows, sizes = [], (700, 300, 12, 3)
    for host, size in enumerate(sizes):
        for i in range(size):
            body = rnd.random() < 0.6
            parts = [" ".join(f"own{host}x{i}x{j}x{k}" for k in range(rnd.randrange(1, 12))) for j in range(rnd.randrange(1, 5))]
            parts += [t for share, t in shared.items() if rnd.random() * 100 < share]
            if rnd.random() < 0.02 and rows:
                parts, body = rows[-1][2], rows[-1][3]
            rows.append((host, len(rows), parts, body))
    tag = {True: "article", False: "div"}
    html = [(n, f"http://h{h}.org/{n}", f"<{tag[b]}>" + "".join(f"<p>{x}</p>" for x in t) + f"</{tag[b]}>") for h, n, t, b in rows]
    out = {r.page_id: r.text for r in extract(spark.createDataFrame(html, "page_id long, url string, html string")).collect()}
    changed = 0
    for host in range(len(sizes)):
        mine = [r for r in rows if r[0] == host]
        want = plain_clean([r[2] for r in mine], [r[3] for r in mine])
        assert [out[r[1]] for r in mine] == ["\n\n".join(t) for t in want]
        changed += sum(w != r[2] for w, r in zip(want, mine, strict=True))
    print("pages changed by the suffix arrays:", changed)
    assert changed > 300


def test_a_very_long_page(spark):
    page = "<article>" + "".join(f"<p>{' '.join(f'w{i}x{j}' for j in range(50))}</p>" for i in range(4000)) + "</article>"
    (r,) = extract(spark.createDataFrame([(1, "http://h.org/", page)], "page_id long, url string, html string")).collect()
    assert r.text.count("\n\n") == 3999 and r.n_chars == len(r.text)
