import numpy as np

from geoloom.llm import ngram_join
from geoloom.llm.components import components
from geoloom.llm.ngram_join import join, representatives

from .conftest import corpus, frame, words


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), 1 << 60), rows[i][0])
    return sorted((rows[i][0], len(sets[i]), least[find(i)], links[i]) for i in range(n))


def test_like_brute_force(spark, rows):
    for k, percent in ((4, 85), (2, 50)):
        assert sorted(map(tuple, join(frame(spark, rows), k, percent).collect())) == brute(rows, k, percent)


def test_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 3)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i] + ["x%d" % i] + base[i:])) for i in range(20)] + corpus(5, 20)[:12][9:]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert sorted(map(tuple, join(frame(spark, rows), 3, 80).collect())) == brute(rows, 3, 80)


def test_repeated_rows(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(5, " ".join(base))] * 3 + [(6, " ".join(base[1:]))] * 2 + [(7, " ".join(base[2:]))]
    assert sorted(map(tuple, join(frame(spark, rows), 4, 85).collect())) == brute(rows, 4, 85)


def test_edges(spark):
    t = "a b c d e f g"
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_shingles, r.n_links) for r in join(frame(spark, [(5, t), (5, t), (None, t), (5, "z"), (6, None), (7, "")]), 4, 85).collect())
    assert got == [(-1, 4, 2), (5, 1, 0), (5, 4, 2), (5, 4, 2), (6, 0, 0), (7, 0, 0)]
    assert join(frame(spark, [(1, t)]).limit(0)).count() == 0
    kept = representatives(frame(spark, [(5, t), (5, t), (4, t), (5, "z"), (6, None), (7, "")]))
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(4, t), (5, "z"), (6, ""), (7, "")]
    assert "row" in kept.columns


def test_components(spark):
    e = [(i, i + 1) for i in range(30)] + [(100, 101), (7, 7), (50, 50), (101, 100)]
    got = dict(map(tuple, components(spark.createDataFrame(e, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_classes(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(40)] + [(100 + i, " ".join(base[:50] + [f"y{i}"] + base[51:])) for i in range(5)] + [(200 + i, f"own{i} text{i} of{i} its{i} own{i}") for i in range(20)]
    assert sorted(map(tuple, join(frame(spark, rows), 4, 85).collect())) == brute(rows, 4, 85)
    assert sorted(r.doc_id for r in representatives(frame(spark, rows), 4, 85).collect()) == [0, *range(200, 220)]


def test_a_very_long_text(spark):
    base = [f"w{i}" for i in range(60_000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:55_000])), (3, " ".join(base[:30_000]))]
    assert sorted(map(tuple, join(frame(spark, rows), 4, 85).collect())) == [(1, 59_997, 1, 1), (2, 54_997, 1, 1), (3, 29_997, 3, 0)]


def test_chance_runs_chain_no_groups(spark):
    """Each text shares runs with the next and is far from the threshold: no group of all."""
    rows = [(i, " ".join(f"w{j}" for j in range(100 * i, 100 * i + 140))) for i in range(30)]
    rows += [(100 + i, " ".join([*(f"v{j}" for j in range(100)), f"x{i}"])) for i in range(3)]
    nodes = ngram_join._nodes(frame(spark, rows))
    groups = ngram_join.candidates(nodes, ngram_join.checkpoint(ngram_join._classes(nodes, 4)), 4, 80)
    assert sorted(map(tuple, groups.collect())) == [(100, 100), (101, 100), (102, 100)]
    assert sorted(map(tuple, join(frame(spark, rows), 4, 80).collect())) == brute(rows, 4, 80)


def test_split_groups_like_brute_force(spark, monkeypatch):
    """Every shared shingle hangs its classes together, and every group is split."""
    monkeypatch.setattr(ngram_join, "TILE", 3)
    monkeypatch.setattr(ngram_join, "PAIRED", 0)
    rows = corpus(1)
    for k, percent in ((4, 85), (2, 30)):
        assert sorted(map(tuple, join(frame(spark, rows), k, percent).collect())) == brute(rows, k, percent)


def test_bitmaps_lose_no_link():
    rnd = np.random.default_rng(3)
    for n in (1, 7, 64, 65, 300, 2000):
        s = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
        for cut in (0, 1, n // 8, n // 3):
            other = np.unique(np.r_[s[cut:], rnd.integers(0, 1 << 63, cut // 2).astype(np.uint64)])
            x, y = ngram_join._bitmap(s), ngram_join._bitmap(other)
            words = min(len(x), len(y)) // 8
            differ = int(np.bitwise_count(ngram_join._folded([x], words) ^ ngram_join._folded([y], words)).sum())
            assert differ <= len(np.setxor1d(s, other))
