import corpus_pipeline as p

from . import test_decontaminate, test_lines, test_ngram_join
from .conftest import SCHEMA, corpus


def test_stages_like_brute_force(spark, tmp_path):
    import random

    rnd = random.Random(11)
    stop = ["the", "of", "and", "in", "is"]
    text = lambda n: "\n".join(" ".join(rnd.choice(stop) if rnd.random() < 0.3 else f"word{rnd.randrange(3000)}" for _ in range(10)) for _ in range(n))
    item = " ".join(f"item{i}" for i in range(30))
    texts = [text(rnd.randrange(6, 15)) for _ in range(40)]
    texts += texts[:6] + [t + "\nsome more words at the end" for t in texts[6:10]] + [texts[11].replace("\n", " ")]
    texts[12] += "\n" + item
    texts[13] = texts[13] + "\n" + item.replace("item3 ", "changed ")
    texts += [None, "", "short", "### " * 80]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in corpus(3)]
    spark.createDataFrame([(i, t, None, None, None) for i, t in rows], ",".join(SCHEMA.split(",")[:5])).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns

    # Each stage against a plain version over its own input.
    out = p.STAGES[0][1](spark, docs, str(tmp_path))
    kept = {r.doc_id: r.text for r in out.collect()}
    assert set(range(40)) <= set(kept) and not {51, 52, 53, 54} & set(kept) and out.columns == columns
    out = p.STAGES[1][1](spark, out, str(tmp_path))
    want = {i: t for i, (n, m, _, t) in test_lines.brute(list(kept.items()), 2).items() if m == 0 or m < n}
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept == want and out.columns == columns
    out = p.STAGES[2][1](spark, out, str(tmp_path))
    want = {c for _, _, c, _ in test_ngram_join.brute(sorted(kept.items()), p.NEAR_WORDS, p.NEAR_PERCENT)}
    kept = {r.doc_id: r.text for r in out.collect()}
    assert set(kept) == want and out.columns == columns
    out = p.STAGES[3][1](spark, out, str(tmp_path))
    want = {i for i, t in kept.items() if test_decontaminate.distance(item.split(), t.lower().split()) > 6}
    kept = {r.doc_id: r.text for r in out.collect()}
    assert set(kept) == want and 12 not in kept and 13 not in kept and out.columns == columns
    out = p.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in out} == kept
    assert all(r.decoded == r.text and r.n_tokens == len(r.token_ids) for r in out)


def _tables(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_empty_tables(spark, tmp_path):
    _tables(spark, tmp_path, [], ",".join(SCHEMA.split(",")[:5]))
    out = p.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_repeated_rows_and_clashing_names(spark, tmp_path):
    import random

    rnd = random.Random(4)
    stop = ["the", "of", "and", "in", "is"]
    text = lambda: "\n".join(" ".join(rnd.choice(stop) if rnd.random() < 0.3 else f"word{rnd.randrange(3000)}" for _ in range(10)) for _ in range(9))
    texts = [text() for _ in range(5)]
    rows = [(i, t, None, None, None, f"t{i}", i, "x", 1.5, True) for i, t in enumerate(texts)] * 3 + [(None, texts[0] + "\nand more", None, None, None, "n", 0, None, None, None), (9, None, None, None, None, "n", 0, None, None, None)]
    _tables(spark, tmp_path, rows, ",".join(SCHEMA.split(",")[:5]) + ", token_ids string, n_tokens int, doc string, class double, gone boolean")
    out = p.run(spark, str(tmp_path))
    assert {"token_ids_in", "n_tokens_in", "doc", "class", "gone", "token_ids", "n_tokens", "decoded"} <= set(out.columns)
    got = out.collect()
    # Copies are one document each; the null id comes before the others and keeps the text of the first.
    assert sorted(r.token_ids_in for r in got) == ["n", "t1", "t2", "t3", "t4"]
    assert all(r.decoded == r.text and r.n_tokens == len(r.token_ids) for r in got)
    assert all(r["class"] == 1.5 and r.gone for r in got if r.doc_id is not None)
    # The folders of the stages that were read are gone.
    folder = out.inputFiles()[0].rsplit("/", 2)[0].removeprefix("file://").removeprefix("file:")
    import os

    assert os.listdir(folder) == ["4"]
