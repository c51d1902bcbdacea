"""HTML extraction by suffix arrays over the pages of a host (operator 8).

A page is parsed once into blocks of text.  Elements decide what can't be article text: menus,
page headers, footers, sidebars, forms, scripts, styles, hidden parts.  Class names and ids decide
where no article or main element does; inside one they only count on boxes, as whole names
(``related-work`` is none), and those of ambiguous words (``menu``, ``share``) go only if the
box is short or mostly links.  What is left is the page's body, or open text where a page has no body.

The suffix arrays then decide on what repeats.  Pages are dealt to blocks by host; a host too
large for a block is cut to shards by the hash of the text, so copies of a page meet.  In a block
the token streams are concatenated and their suffixes sorted by prefix doubling; an interval with
a common prefix of ``RUN`` tokens is a run, overlapping runs form the maximal repeated substrings.
A run's distinct pages are those of its whole host, however many blocks this has:

* bodies: boilerplate is on half of the host's bodies and on ``BODY_PAGES`` at least.  Such a run
  is on half of a shard's bodies in one shard at least, so shards name these candidates, all shards
  of the host count them, and the sums go back;
* open text: boilerplate is on ``OPEN_PAGES`` distinct pages.  Shards report all their runs, Spark
  sums them by hash and returns those that reach the number.

Covered tokens are removed and unique runs stay.  Near copies of an article repeat each other, not
boilerplate: a body stays whole where over ``NEAR_SHARE`` of its runs are on ``OPEN_PAGES`` pages among
the bodies that hold boilerplate (these report all their runs), and an open page where over
``OPEN_SHARE`` of it is covered.  Copies count as one page; runs are equal by 64 bits of hash over
all their tokens and the host.

Defined results: null or empty html and pages without text give an empty text; unclosed tags,
quotes and comments and cut-off pages are read as far as they go; null urls are one host;
repeated pages are copies.  Other columns are dropped.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import text as T

BLOCK_PAGES = 256
#: Slots in which the pages of hosts are counted to cut large ones; hosts of one slot are cut alike.
SLOTS = 1 << 20
#: Buckets that the runs of all blocks are summed in, one for so many pages.
BUCKET_PAGES, MOST_BUCKETS = 2000, 2048
RUN = 8
OPEN_PAGES = 3
BODY_PAGES = 10
#: Share of a body's runs on other bodies too, and of an open page's runs that are boilerplate, beyond which the page is a near copy.
NEAR_SHARE, OPEN_SHARE = 0.5, 0.9
#: A box of an ambiguous name goes with so many words at most, or if half of its words are links.
SHORT_BOX = 12

#: A quoted value ends at its quote if a space, a slash or the tag's end follows; else it is read as unquoted.
_ATTRIBUTE = r"""[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"(?=[\s/>]|\Z)|'[^']*+'(?=[\s/>]|\Z)|[^\s>]*+))?+"""
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/=]++|{_ATTRIBUTE})*+)(?:>|\Z)", re.S)
_PAIR = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"(?=[\s/>]|\Z)|'([^']*+)'(?=[\s/>]|\Z)|([^\s>]*+)))?+""", re.S)
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
_CHROME = {"nav", "footer", "aside", "form", "button", "select", "dialog", "template", "noscript", "svg", "object", "video", "audio", "canvas", "menu", "head", "map"}
_BODY = {"article", "main"}
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul head".split()
)
_BOX = {"div", "section", "ul", "ol", "dl", "table", "header", "details"}
_VOID = {"hr", "br", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Elements that end an open one of the second set.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_COMMENT = set("comment comments commentlist disqus replies respond reviews".split())
#: Words in class names and ids of chrome; those of the second line are ambiguous inside a body.
_SURE = _COMMENT | set(
    "nav navbar navigation masthead topbar footer sidebar ad ads advert adverts advertisement advertising sponsored cookie cookies consent gdpr newsletter "
    "breadcrumb breadcrumbs pagination pager login signup searchform".split()
)
_AMBIGUOUS = set("menu submenu aside sponsor banner notice notices alert popup modal overlay subscribe subscription promo promotion related recommended share sharing social search widget widgets toolbar skip reply review".split())
_CHROME_WORDS = _SURE | _AMBIGUOUS
#: Words that may stand beside a word of chrome in one name.
_BESIDE = set(
    "area article articles bar block bottom box button buttons col column container content form global group header holder icon icons inner item items left link links list main "
    "outer page panel post posts primary right row secondary section site slot stories text this top unit us wrap wrapper zone".split()
)
#: Class names and ids that stand for a body where a page has no better one.
_WEAK = set("content main main-content maincontent article article-body article-content post post-content post-body entry entry-content story story-body page-content".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())

NO, CHROME, SOFT, BODY, WEAK, MAYBE = range(6)


def _words(names: list[str]) -> set[str]:
    """The words of chrome in names that hold no other than such and those beside them."""
    out: set[str] = set()
    for name in names:
        parts = [p for p in re.split(r"[-_]+", name) if p and not p.isdigit()]
        if all(p in _CHROME_WORDS or p in _BESIDE for p in parts):
            out.update(p for p in parts if p in _CHROME_WORDS)
    return out


def _kind(name: str, attrs: str, in_body: bool) -> int:
    """CHROME, SOFT (chrome by its names, in which a body may still open), MAYBE (an ambiguous box of a body), BODY, WEAK (body by its names) or NO."""
    if name in _CHROME:
        return CHROME
    if name == "header":
        return NO if in_body else SOFT
    found = {}
    if attrs:
        for key, a, b, c in _PAIR.findall(attrs):
            found.setdefault(key.lower(), (a or b or c).lower())
    names = (found.get("class", "") + " " + found.get("id", "")).split()
    role = found.get("role", "").split()[:1]
    if name in _BODY or role in (["main"], ["article"]):
        return CHROME if _words(names) & _COMMENT else BODY
    if not found or name in ("html", "body"):
        return NO
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "") or (role and role[0] in _ROLES):
        return CHROME
    words = _words(names) if names else set()
    if in_body:
        if name not in _BOX or not words:
            return NO
        return CHROME if words & _SURE else MAYBE
    if words:
        return CHROME if words & _COMMENT else SOFT
    return WEAK if any(n in _WEAK for n in names) else NO


def _state(stack: list[tuple[str, int]]) -> int:
    """What text under the open elements is: the last of body and chrome by names, but chrome proper always."""
    z = NO
    for _, kind in stack:
        if kind == CHROME:
            return CHROME
        if kind in (SOFT, BODY) or (kind == WEAK and z == NO):
            z = kind
    return z


@dataclass
class _Box:
    """An open box of an ambiguous name: its depth in the stack, where its blocks begin, its words and those in links."""

    depth: int
    into: list[str]
    begin: int
    words: int = 0
    links: int = 0


def blocks(page: str | None) -> tuple[list[str], bool]:
    """The page's text blocks without chrome, and whether they are its body (else open)."""
    page = page or ""
    found: dict[int, list[str]] = {BODY: [], WEAK: [], NO: []}
    stack: list[tuple[str, int]] = []
    boxes: list[_Box] = []
    run: list[str] = []
    zone = run_zone = NO
    link = linked = 0

    def text(t: str) -> None:
        nonlocal run_zone, linked
        if zone in found:
            if not run:
                run_zone = zone
            run.append(t)
            if link and boxes:
                linked += len(t.split())

    def flush() -> None:
        nonlocal linked
        if run:
            t = "".join(run)
            t = " ".join((_html.unescape(t) if "&" in t else t).split())
            if t:
                found[run_zone].append(t)
                for b in boxes:
                    b.words += t.count(" ") + 1
                    b.links += linked
            run.clear()
        linked = 0

    def close(to: int) -> None:
        """The open elements from ``to`` on end."""
        nonlocal zone
        del stack[to:]
        zone = _state(stack)
        while boxes and boxes[-1].depth >= to:
            flush()
            b = boxes.pop()
            if b.words <= SHORT_BOX or 2 * b.links >= b.words:
                del b.into[b.begin :]

    at = 0
    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        closing, attrs = m[1], m[3]
        block = name in _BLOCK
        if not closing and name in _RAW:
            end = re.compile(rf"(?i)</{name}\s*>").search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            text(" ")
            continue
        if name == "a":
            link = not closing
        if closing:
            if block:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        kind = _kind(name, attrs, zone == BODY)
        if not block and kind == NO:
            continue
        if block:
            flush()
            # An open paragraph ends, whatever phrase is still open in it.
            k = len(stack)
            while k and stack[k - 1][0] not in _BLOCK:
                k -= 1
            if k and stack[k - 1][0] == "p":
                close(k - 1)
            ends = _ENDS.get(name)
            while ends and stack and stack[-1][0] in ends:
                close(len(stack) - 1)
        if name not in _VOID and not attrs.endswith("/"):
            if kind == MAYBE:
                boxes.append(_Box(len(stack), found[BODY], len(found[BODY])))
            stack.append((name, kind))
        zone = _state(stack)
    if at < len(page):
        text(page[at:])
    flush()
    close(0)
    for kind in (BODY, WEAK):
        if found[kind]:
            return found[kind], True
    return found[NO], False


def suffix_intervals(ids: np.ndarray, length: int) -> np.ndarray:
    """For each suffix of ids its interval of the suffix array by the first ``length`` ids.

    Prefix doubling: a rank by ``2 * n`` ids is the rank of the pair of ranks by n.  The last
    step overlaps where length is no power of two.  Suffixes that are too short get their own.
    """
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    n = 1
    while n < length:
        step = min(n, length - n)
        nxt = np.full(len(rank), -1, np.int64)
        nxt[: len(rank) - step] = rank[step:]
        pair = rank * (len(rank) + 1) + nxt + 1
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        n += step
    return rank


@dataclass
class Runs:
    """The runs of a block of pages: each position's run, and group, key and distinct pages of each run."""

    flat: list[str]
    page: np.ndarray  # page of each text block
    first: np.ndarray  # word offset of each text block
    of_page: np.ndarray  # page of each word
    at: np.ndarray  # words at which a run begins
    which: np.ndarray  # their runs
    group: np.ndarray
    keys: np.ndarray
    spans: np.ndarray


def _pages_key(groups: np.ndarray) -> np.ndarray:
    """Key under which a group's distinct pages are counted."""
    return T.mix(groups + np.uint64(0x5851F42D4C957F2D))


def groups_of(hosts: np.ndarray, body: np.ndarray) -> np.ndarray:
    """The bodies and the open pages of a host are counted apart."""
    return T.mix(hosts ^ np.where(body, np.uint64(0x14057B7EF767814F), np.uint64(0)))


def distinct_pages(texts: list[list[str]], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the distinct page that each page is, groups, their distinct pages); copies in a group are one."""
    same: dict = {}
    distinct = np.array([same.setdefault((int(x), tuple(t)), len(same)) for x, t in zip(groups, texts, strict=True)], np.int64)
    of, n = np.unique(np.array([x for x, _ in same], np.uint64), return_counts=True)
    return distinct, of, n


def runs_of(texts: list[list[str]], groups: np.ndarray, distinct: np.ndarray) -> Runs | None:
    flat = [b for t in texts for b in t]
    if not flat:
        return None
    page = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    words = list(T.blocks(pa.array(flat, pa.large_string()), 1 << 62))[0]
    h = words.hashes()
    if len(h) < RUN:
        return None
    of_page = page[np.repeat(np.arange(len(flat)), words.counts)]
    # A separator that no other page has follows each page.
    cut = np.flatnonzero(np.r_[of_page[1:] != of_page[:-1], True]) + 1
    ids = np.insert(h, cut, T.mix(np.arange(len(cut), dtype=np.uint64) + np.uint64(1 << 40)))
    behind = np.searchsorted(cut, np.arange(len(h)), "right")
    place = np.arange(len(h)) + behind
    at = np.flatnonzero(np.arange(len(h)) + RUN <= cut[behind])
    if not len(at):
        return None
    interval = suffix_intervals(ids, RUN)[place[at]]
    names, group = np.unique(groups, return_inverse=True)
    _, head, which = np.unique(interval * np.int64(len(names)) + group[of_page[at]], return_index=True, return_inverse=True)
    own = groups[of_page[at[head]]]
    keys = T.mix(T.windows(h, RUN)[at[head]] ^ T.mix(own))
    pages = np.int64(distinct.max() + 1)
    spans = np.bincount(np.unique(which * pages + distinct[of_page[at]]) // pages, minlength=len(keys))
    return Runs(flat, page, words.first, of_page, at, which, own, keys, spans)


def boilerplate(body: np.ndarray, runs: Runs, spans: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """Which positions begin a run of boilerplate; spans are the pages of each run and pages those of each page's group."""
    least = np.where(body, np.maximum(BODY_PAGES, -(-pages // 2)), OPEN_PAGES)
    return spans[runs.which] >= least[runs.of_page[runs.at]]


def holders(body: np.ndarray, runs: Runs, boiler: np.ndarray) -> np.ndarray:
    """The bodies with boilerplate."""
    held = np.zeros(len(body), bool)
    held[runs.of_page[runs.at[boiler]]] = True
    return held & body


def spans_within(runs: Runs, distinct: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Distinct pages of each run among the chosen ones."""
    of = runs.of_page[runs.at]
    pages = np.int64(distinct.max() + 1)
    go = chosen[of]
    return np.bincount(np.unique(runs.which[go] * pages + distinct[of[go]]) // pages, minlength=len(runs.keys))


def without(texts: list[list[str]], body: np.ndarray, runs: Runs, boiler: np.ndarray, near: np.ndarray) -> list[list[str]]:
    """The blocks without boilerplate; near are the pages of each run among the bodies with boilerplate."""
    of = runs.of_page[runs.at]
    total = np.maximum(np.bincount(of, minlength=len(texts)), 1)
    alike = np.bincount(of, near[runs.which] >= OPEN_PAGES, len(texts)) / total
    covered = np.bincount(of, boiler, len(texts)) / total
    boiler = boiler & np.where(body, alike <= NEAR_SHARE, covered <= OPEN_SHARE)[of]
    if not boiler.any():
        return texts
    step = np.zeros(len(runs.of_page) + 1, np.int64)
    hits = runs.at[boiler]
    np.add.at(step, hits, 1)
    np.add.at(step, hits + RUN, -1)
    gone = np.cumsum(step[:-1]) > 0
    out: list[list[str]] = [[] for _ in texts]
    for i, b in enumerate(runs.flat):
        a, z = int(runs.first[i]), int(runs.first[i + 1])
        if gone[a:z].any():
            b = " ".join(w for w, g in zip(b.split(" "), gone[a:z], strict=False) if not g)
        if b:
            out[runs.page[i]].append(b)
    return out


def clean_group(texts: list[list[str]], body: list[bool]) -> list[list[str]]:
    """The blocks of all pages of one host without boilerplate."""
    zone = np.array(body)
    groups = groups_of(np.zeros(len(texts), np.uint64), zone)
    distinct, of, n = distinct_pages(texts, groups)
    runs = runs_of(texts, groups, distinct)
    if runs is None:
        return texts
    boiler = boilerplate(zone, runs, runs.spans, n[np.searchsorted(of, groups)])
    return without(texts, zone, runs, boiler, spans_within(runs, distinct, holders(zone, runs, boiler)))


_PARSED = "ids array<long>, urls array<string>, host long, shards int, text string, body boolean"


def _parser(slots, shards):
    """Pages to blocks of text; copies in a batch are one row."""

    def parse(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                c = b.slice(k, 256)
                rows: dict = {}
                for i, url, host, page in zip(*[c.column(x).to_pylist() for x in ("page_id", "url", "host", "html")], strict=True):
                    parts, body = blocks(page)
                    ids, urls = rows.setdefault((host, "\n".join(parts), body), ([], []))
                    ids.append(i)
                    urls.append(url)
                host = np.array([h for h, _, _ in rows], np.int64)
                slot = host % SLOTS
                at = np.minimum(np.searchsorted(slots.value, slot), max(len(slots.value) - 1, 0))
                cut = np.where(slots.value[at] == slot, shards.value[at], 1) if len(slots.value) else np.ones(len(host), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x for x, _ in rows.values()], pa.list_(pa.int64())), pa.array([x for _, x in rows.values()], pa.list_(pa.string())),
                        pa.array(host), pa.array(cut.astype(np.int32)), pa.array([t for _, t, _ in rows], pa.string()), pa.array([x for _, _, x in rows], pa.bool_()),
                    ],
                    ["ids", "urls", "host", "shards", "text", "body"],
                )

    return parse


def _read(t: pa.Table) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """Blocks, group and zone of each page."""
    texts = [x.split("\n") if x else [] for x in t.column("text").to_pylist()]
    body = t.column("body").to_numpy(zero_copy_only=False).astype(bool)
    return texts, groups_of(t.column("host").to_numpy().view(np.uint64), body), body


def _cut_hosts(t: pa.Table) -> pa.Table:
    """The pages of hosts that other blocks hold pages of too."""
    return t.filter(pa.array((t.column("shards").to_numpy() > 1) & np.array([bool(x) for x in t.column("text").to_pylist()], bool)))


def _candidates(t: pa.Table) -> pa.Table:
    """host, keys: for each cut host the runs on half of the block's bodies."""
    t = _cut_hosts(t)
    t = t.filter(t.column("body"))
    texts, groups, _ = _read(t)
    host = dict(zip(groups.tolist(), t.column("host").to_pylist(), strict=True))
    rows = {"host": [], "keys": []}
    if texts:
        distinct, of, n = distinct_pages(texts, groups)
        runs = runs_of(texts, groups, distinct)
        for g, pages in zip(of, n, strict=True):
            often = (runs.group == g) & (2 * runs.spans >= pages) if runs else np.empty(0, bool)
            if often.any():
                rows["host"].append(host[int(g)])
                rows["keys"].append(runs.keys[often].view(np.int64).tolist())
    return pa.table(rows, schema=pa.schema([("host", pa.int64()), ("keys", pa.list_(pa.int64()))]))


_COUNTS = "bucket int, block long, keys binary, counts binary"


def _bucketed(block: list, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    to = (keys % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(to, kind="stable")
    found, begin = np.unique(to[order], return_index=True)
    parts = np.split(order, begin[1:]) if len(found) else []
    counts = counts.astype(np.int32)
    return pa.table(
        [pa.array(found, pa.int32()), pa.array(block * len(found), pa.int64()), pa.array([keys[p].tobytes() for p in parts], pa.binary()), pa.array([counts[p].tobytes() for p in parts], pa.binary())],
        ["bucket", "block", "keys", "counts"],
    )


def _counter(buckets: int):
    def count(t: pa.Table, wanted: pa.Table) -> pa.Table:
        """The block's open runs and the wanted ones of bodies with their distinct pages, and the pages of its groups (below 0), by bucket."""
        block = t.column("block").to_pylist()[:1]
        t = _cut_hosts(t)
        texts, groups, body = _read(t)
        if not texts:
            return _bucketed(block, np.empty(0, np.uint64), np.empty(0, np.int32), buckets)
        distinct, of, pages = distinct_pages(texts, groups)
        keys, n = _pages_key(of), -pages
        asked = np.array([x for r in wanted.column("keys").to_pylist() for x in r], np.int64).view(np.uint64)
        runs = runs_of(texts, groups, distinct) if len(asked) or not body.all() else None
        if runs:
            go = np.isin(runs.group, groups[~body]) | np.isin(runs.keys, asked)
            keys, n = np.r_[keys, runs.keys[go]], np.r_[n, runs.spans[go]]
        return _bucketed(block, keys, n, buckets)

    return count


def _sum(t: pa.Table) -> pa.Table:
    """For each block of a bucket the sums over all blocks of its runs that reach the least count, and of its groups."""
    blobs = t.column("keys").to_pylist()
    keys = np.frombuffer(b"".join(blobs), np.uint64)
    counts = np.frombuffer(b"".join(t.column("counts").to_pylist()), np.int32)
    _, which = np.unique(keys, return_inverse=True)
    total = np.bincount(which, counts).astype(np.int64)[which]
    go = (total >= OPEN_PAGES) | (total < 0)
    ends = np.cumsum([len(b) // 8 for b in blobs])
    rows = []
    for block, a, z in zip(t.column("block").to_pylist(), np.r_[0, ends[:-1]], ends, strict=True):
        if go[a:z].any():
            rows.append((block, keys[a:z][go[a:z]].tobytes(), total[a:z][go[a:z]].tobytes()))
    block, k, n = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table([pa.array(block, pa.int64()), pa.array(k, pa.binary()), pa.array(n, pa.binary())], ["block", "keys", "totals"])


_SUMS = "block long, keys binary, totals binary"


class _Judged:
    """The pages of a block with the boilerplate that the sums over their hosts tell."""

    def __init__(self, t: pa.Table, sums: pa.Table):
        self.texts, self.groups, self.body = _read(t)
        self.runs = None
        self.boiler = np.empty(0, bool)
        if not self.texts:
            return
        cut = t.column("shards").to_numpy() > 1
        keys, total = _lookup(sums)
        # Without sums of runs no run of a cut host is boilerplate.
        if (~cut).any() or (total > 0).any():
            self.distinct, of, n = distinct_pages(self.texts, self.groups)
            self.runs = runs_of(self.texts, self.groups, self.distinct)
        if self.runs:
            pages = np.where(cut, -_look(keys, total, _pages_key(self.groups)), n[np.searchsorted(of, self.groups)])
            self.cut_runs = np.isin(self.runs.group, self.groups[cut])
            spans = np.where(self.cut_runs, _look(keys, total, self.runs.keys), self.runs.spans)
            self.boiler = boilerplate(self.body, self.runs, spans, pages)


def _lookup(sums: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(b"".join(sums.column("keys").to_pylist()), np.uint64)
    total = np.frombuffer(b"".join(sums.column("totals").to_pylist()), np.int64)
    order = np.argsort(keys)
    return keys[order], total[order]


def _look(keys: np.ndarray, total: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x), np.int64)
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[i] == x, total[i], 0)


def _alike(buckets: int):
    def count(t: pa.Table, sums: pa.Table) -> pa.Table:
        """All runs of the bodies of cut hosts that hold boilerplate, with their distinct pages among these."""
        block = t.column("block").to_pylist()[:1]
        j = _Judged(_cut_hosts(t), sums)
        if not j.boiler.any():
            return _bucketed(block, np.empty(0, np.uint64), np.empty(0, np.int32), buckets)
        n = spans_within(j.runs, j.distinct, holders(j.body, j.runs, j.boiler))
        return _bucketed(block, j.runs.keys[n > 0], n[n > 0], buckets)

    return count


def _clean(t: pa.Table, sums: pa.Table) -> pa.Table:
    is_near = sums.column("near").to_numpy(zero_copy_only=False).astype(bool)
    j = _Judged(t, sums.filter(pa.array(~is_near)))
    texts = j.texts
    if j.boiler.any():
        keys, total = _lookup(sums.filter(pa.array(is_near)))
        near = np.where(j.cut_runs, _look(keys, total, j.runs.keys), spans_within(j.runs, j.distinct, holders(j.body, j.runs, j.boiler)))
        texts = without(texts, j.body, j.runs, j.boiler, near)
    joined = ["\n\n".join(x) for x in texts]
    ids, urls = t.column("ids").to_pylist(), t.column("urls").to_pylist()
    each = np.repeat(np.arange(len(ids)), [len(x) for x in ids]).tolist()
    return pa.table(
        [pa.array([x for y in ids for x in y], pa.int64()), pa.array([x for y in urls for x in y], pa.string()), pa.array([joined[k] for k in each], pa.string()), pa.array([len(joined[k]) for k in each], pa.int64())],
        ["page_id", "url", "text", "n_chars"],
    )


def extract(pages: DataFrame, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    T.bound_batches(pages)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"(?s)://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.xxhash64(host).alias("host"), F.col("html").cast("string").alias("html"))
    total = rows.count()
    n_blocks = max(1, -(-total // block_pages))
    buckets = min(MOST_BUCKETS, max(16, total // BUCKET_PAGES))
    # At most SLOTS rows come to the driver, each for over block_pages pages.
    large = rows.groupBy(F.pmod("host", F.lit(SLOTS)).alias("slot")).count().where(F.col("count") > block_pages).orderBy("slot").toArrow()
    send = pages.sparkSession.sparkContext.broadcast
    slots, shards = send(large["slot"].to_numpy()), send(-(-large["count"].to_numpy() // block_pages))
    parsed = rows.mapInArrow(_parser(slots, shards), _PARSED)
    # Copies meet; pages without text have no runs and are spread.
    shard = F.pmod(F.xxhash64("text"), F.col("shards"))
    block = F.pmod(F.when(F.col("text") == "", F.xxhash64("ids", "urls")).otherwise(F.xxhash64("host", shard)), F.lit(n_blocks))
    dealt = parsed.withColumn("block", block).repartition("block")
    keys = dealt.groupBy("block").applyInArrow(_candidates, "host long, keys array<long>").select("host", F.explode("keys").alias("key")).distinct()
    places = dealt.where("body AND shards > 1 AND text <> ''").select("host", F.col("block").alias("into")).distinct()
    wanted = places.join(keys, "host").groupBy("into").agg(F.collect_list("key").alias("keys"))
    counts = dealt.groupBy("block").cogroup(wanted.groupBy("into")).applyInArrow(_counter(buckets), _COUNTS)
    sums = counts.groupBy("bucket").applyInArrow(_sum, _SUMS)
    alike = dealt.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(_alike(buckets), _COUNTS)
    near = alike.groupBy("bucket").applyInArrow(_sum, _SUMS)
    told = sums.withColumn("near", F.lit(False)).unionAll(near.withColumn("near", F.lit(True)))
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_clean, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
