import random

from geoloom.llm.substring import _prepared, compacted, remove_repeats, repeated_paths, verified

from .conftest import frame, words


def brute(rows, k):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        gone = set()
        for s in range(len(w) - k + 1):
            if first.setdefault(tuple(w[s : s + k]), (i, s)) != (i, s):
                gone |= set(range(s, s + k))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def test_like_brute_force(spark, rows):
    for k, seed in ((20, 10), (6, 3)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in remove_repeats(frame(spark, rows), k, seed).collect()}
        assert got == brute(rows, k)


def test_edges(spark):
    t = " ".join(f"w{i}" for i in range(25))
    out = remove_repeats(frame(spark, [(1, t), (1, t), (None, t), (2, "a b"), (2, t)]))
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_removed) for r in out.collect())
    assert got == [(-1, 0), (1, 25), (1, 25), (2, 0), (2, 25)]
    assert remove_repeats(frame(spark, [(1, t)]).limit(0)).count() == 0
    same = remove_repeats(frame(spark, [(1, t), (1, t)])).collect()
    assert [r.n_removed for r in same] == [0, 0]
    run = remove_repeats(frame(spark, [(3, "x " * 60)])).collect()[0]
    assert (run.n_words, run.n_removed) == (60, 59)


def test_spans_are_maximal_and_verified(spark):
    rnd = random.Random(4)
    w = [f"w{rnd.randrange(10**6)}" for _ in range(500)]
    docs = frame(spark, [(1, " ".join(w)), (2, " ".join(["own"] * 3 + w[40:460])), (3, "\t".join(w[100:200]) + "  end")])
    rows = _prepared(docs)
    paths = repeated_paths(rows)
    spans = compacted(paths)
    # Cut at many keys, glued to one span a copy.
    assert paths.count() > 20
    got = sorted((r.doc, r.start, r.n) for r in spans.collect())
    assert got == [(2, 3, 401), (3, 0, 81)]
    assert verified(rows, spans, 20).count() == 2
    # A span that isn't what its source says goes.
    wrong = spans.selectExpr("doc", "part", "start", "from_doc", "from_part", "from_start + CASE WHEN doc = 2 THEN 1 ELSE 0 END AS from_start", "n")
    assert [r.doc for r in verified(rows, wrong, 20).collect()] == [3]


def test_a_very_long_text(spark):
    rnd = random.Random(6)
    w = [f"w{rnd.randrange(10**6)}" for _ in range(200_000)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in remove_repeats(frame(spark, [(1, " ".join(w)), (2, " ".join(w[:150_000])), (3, "x " * 100_000)])).collect()}
    assert got == {1: (200_000, 0), 2: (150_000, 150_000), 3: (100_000, 99_999)}
