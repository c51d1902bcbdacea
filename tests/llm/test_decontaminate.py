import random

import numpy as np
import pyarrow as pa
import pytest

from geoloom.llm import text as T
from geoloom.llm.decontaminate import EDITS, Items, buckets, clean, leaks, stretch_distance

from .conftest import frame


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        nxt = [i]
        for j, x in enumerate(text, 1):
            nxt.append(min(nxt[-1] + 1, row[j] + 1, row[j - 1] + (x != w)))
        row = nxt
    return min(row)


def case(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    items = [[rnd.choice(vocab) for _ in range(n)] for n in (1, 4, 9, 15, 30, 59, 30)]
    docs = []
    for _ in range(40):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(80))]
        for _ in range(rnd.randrange(3)):
            x = list(rnd.choice(items[2:]))
            for _ in range(rnd.randrange(len(x) * 30 // 100 + 1)):
                p = rnd.randrange(len(x))
                x[p : p + rnd.randrange(2)] = [rnd.choice(vocab)] * rnd.randrange(2)
            at = rnd.randrange(len(w) + 1)
            w[at:at] = x
        docs.append(w)
    return items, docs


def test_like_brute_force(spark):
    found = missed = 0
    for seed in range(4):
        items, docs = case(seed)
        d = frame(spark, [(i, " ".join(w).upper()) for i, w in enumerate(docs)])
        b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
        got = {(r.doc_id, r.item_id): r.distance for r in leaks(d, b, item_block=3).collect()}
        want = {(i, k): n for i, w in enumerate(docs) for k, x in enumerate(items) if (n := distance(x, w)) <= len(x) * EDITS // 100}
        assert set(got) <= set(want)
        assert all(got[p] >= want[p] for p in got)
        found, missed = found + len(want), missed + len(set(want) - set(got))
        assert {r.doc_id for r in clean(d, b).collect()} == set(range(len(docs))) - {i for i, _ in got}
    assert found > 60 and missed <= 0.01 * found


def test_recall_at_the_limit():
    rnd, hits, n = random.Random(3), 0, 0
    vocab = [f"w{i}" for i in range(500)]
    for _ in range(200):
        x = [rnd.choice(vocab) for _ in range(rnd.randrange(15, 60))]
        y = list(x)
        for p in rnd.sample(range(len(x)), len(x) * EDITS // 100):
            y[p] = "edited"
        (w,) = T.blocks(pa.array([" ".join([rnd.choice(vocab) for _ in range(50)] + y)]))
        hits += any(True for _ in Items([0], [" ".join(x)]).leaks(w))
        n += 1
    assert hits >= 0.99 * n


@pytest.mark.parametrize("place", ["whole", "start", "end"])
@pytest.mark.parametrize("edit", ["insert", "delete", "mixed"])
def test_recall_at_the_edges(place, edit):
    rnd, hits, n = random.Random(5), 0, 0
    vocab = [f"w{i}" for i in range(500)]
    for _ in range(100):
        x = [rnd.choice(vocab) for _ in range(rnd.randrange(15, 60))]
        y = list(x)
        for p in sorted(rnd.sample(range(len(x)), len(x) * EDITS // 100), reverse=True):
            kind = rnd.choice(["insert", "delete", "replace"]) if edit == "mixed" else edit
            y[p : p + (kind != "insert")] = [] if kind == "delete" else ["edited"]
        other = [rnd.choice(vocab) for _ in range(50)]
        doc = {"whole": y, "start": y + other, "end": other + y}[place]
        ws = T.blocks(pa.array([" ".join(other), " ".join(doc), " ".join(other)]))
        hits += any(d == 1 for w in ws for d, *_ in Items([0], [" ".join(x)]).leaks(w))
        n += 1
    assert hits >= 0.97 * n


def test_recall_of_items_in_segments():
    rnd, hits = random.Random(13), 0
    vocab = [f"w{i}" for i in range(500)]
    for _ in range(60):
        x = [rnd.choice(vocab) for _ in range(rnd.randrange(60, 400))]
        y = list(x)
        for p in sorted(rnd.sample(range(len(x)), len(x) * EDITS // 100), reverse=True):
            y[p : p + rnd.randrange(2)] = ["edited"] * rnd.randrange(2)
        other = [rnd.choice(vocab) for _ in range(50)]
        (w,) = T.blocks(pa.array([" ".join(other + y + other)]))
        hits += any(True for _ in Items([0], [" ".join(x)]).leaks(w))
    assert hits >= 59


def test_stretch():
    rnd = random.Random(1)
    for _ in range(100):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randrange(1, 12))] for _ in range(2))
        assert stretch_distance(np.array(a), np.array(b))[0] == distance(a, b)


def test_edges(spark):
    b = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    d = frame(spark, [(None, "x one two three four five"), (2, None), (3, ""), (4, "one two three four five"), (4, "one two three four five"), (5, "clean")])
    assert {(r.doc_id, r.item_id, r.distance) for r in leaks(d, b).collect()} == {(None, 1, 0), (4, 1, 0)}
    assert sorted(r.doc_id for r in clean(d, b).collect()) == [2, 3, 5]
    assert leaks(d, b.limit(0)).count() == 0 and leaks(d.limit(0), b).count() == 0


def test_a_long_item(spark):
    """An item of 10,000 words in a longer document, edited at the limit."""
    rnd = random.Random(9)
    x = [f"v{rnd.randrange(3000)}" for _ in range(10_000)]
    y = list(x)
    for p in sorted(rnd.sample(range(len(x)), 1400), reverse=True):
        y[p : p + 1] = [] if p % 3 == 0 else ["edited"] * (1 + (p % 3 == 1))
    other = [f"v{rnd.randrange(3000)}" for _ in range(9000)]
    near = [w if rnd.random() < 0.7 else "other" for w in x]
    d = spark.createDataFrame([(1, " ".join(other[:5000] + y + other[5000:])), (2, " ".join(other)), (3, " ".join(near))], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(x))], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in leaks(d, b).collect()] == [(1, 7)]


def test_item_blocks_do_not_matter(spark):
    items, docs = case(11)
    d = frame(spark, [(i, " ".join(w)) for i, w in enumerate(docs)])
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    want = sorted(map(tuple, leaks(d, b).collect()))
    assert want and sorted(map(tuple, leaks(d, b, item_block=1).collect())) == want
    assert sorted(map(tuple, leaks(d, b, item_bytes=100).collect())) == want


def test_embedding_keeps_near_words_near():
    """Equal words share all buckets, near ones some, others none."""
    rnd = random.Random(2)
    x = np.array([rnd.getrandbits(64) | 1 for _ in range(40)], np.uint64)
    near = x.copy()
    near[17] = np.uint64(5)
    other = np.array([rnd.getrandbits(64) | 1 for _ in range(40)], np.uint64)
    k = buckets(np.stack([x, x, near, other]))
    assert (k[:, 0] == k[:, 1]).all()
    assert 0.4 < (k[:, 0] == k[:, 2]).mean() < 1
    assert not (k[:, 0] == k[:, 3]).any()
