from collections import Counter

from geoloom.llm.quality import filter_documents, measure

from .conftest import frame, words


def expected(t):
    w = words(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, rows):
    rows = rows + [(900, "# $ a b c a b c a b c"), (901, "x x x x"), (902, "a\n\na\nb\na"), (903, None), (903, None)]
    for r in measure(frame(spark, rows)).collect():
        t = dict(rows)[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not r.failed_rules)


def test_filter(spark):
    good = "the cat and the dog of that house is in it " + " ".join(f"word{i}" for i in range(60))
    junk = " ".join(f"word{i}### $$$" for i in range(60))
    out = filter_documents(frame(spark, [(1, good), (2, junk), (3, None), (4, "short"), (5, good)]))
    assert sorted(r.doc_id for r in out.collect()) == [1, 5]
    assert out.columns[:2] == ["doc_id", "text"] and "row" in out.columns
    assert filter_documents(frame(spark, [(1, good)]).limit(0)).count() == 0
