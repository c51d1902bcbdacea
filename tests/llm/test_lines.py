import random

import duckdb
import pandas as pd

from geoloom.llm import lines, oracle
from geoloom.llm.lines import dedup, mark, op1_line_dedup

from .conftest import frame, words


def brute(rows, min_lines, min_words=20):
    """Every run of every length, by its first occurrence."""
    seqs = []
    for i, t in sorted(rows, key=lambda r: r[0]):
        all_lines = (t or "").split("\n")
        seqs.append((i, all_lines, [(j, x) for j, x in enumerate(all_lines) if words(x)]))
    longest = {}
    live = {(i, s) for i, _, seq in seqs for s in range(len(seq))}
    size = 1
    of = {i: [x for _, x in seq] for i, _, seq in seqs}
    while live:
        first, again = {}, {}
        for i, s in sorted(live):
            run = tuple(of[i][s : s + size])
            if len(run) == size:
                again.setdefault(run, []).append((i, s))
                if first.setdefault(run, (i, s)) != (i, s):
                    longest[i, s] = size
        live = {x for held in again.values() if len(held) > 1 for x in held}
        size += 1
    out = {}
    for i, all_lines, seq in seqs:
        gone = set()
        for s, (j, x) in enumerate(seq):
            n = longest.get((i, s), 0)
            if n >= min_lines:
                gone |= {seq[s + k][0] for k in range(n)}
            if n and len(words(x)) >= min_words:
                gone.add(j)
        best = max((longest.get((i, s), 0) for s in range(len(seq))), default=0)
        out[i] = (len(seq), len(gone), best if best >= max(2, min_lines) else 0, "\n".join(x for j, x in enumerate(all_lines) if j not in gone))
    return out


def judged(df):
    return {r.row.doc_id: (r.n_lines, r.n_removed, r.longest, r.kept_text) for r in df.collect()}


def test_like_brute_force(spark, rows):
    long = " ".join(f"long{j}" for j in range(20))
    rows = rows + [(500 + i, "\n".join(f"l{j}" for j in range(i, i + 9))) for i in range(4)] + [(600, "q\n" * 20), (601, long), (602, f"a line\n{long}\n\n{long} x"), (603, long[:-7])]
    for k in (1, 2, 3):
        assert judged(mark(frame(spark, rows), k)) == brute(rows, k)
    assert judged(mark(frame(spark, rows), 4, 3)) == brute(rows, 4, 3)


def test_longest_runs_are_exact(spark):
    rnd = random.Random(3)
    base = [f"b{j}" for j in range(40)]
    rows = [(0, "\n".join(base))]
    for i in range(1, 40):  # runs of all lengths, between lines of few kinds
        a = rnd.randrange(40)
        z = rnd.randrange(a, 41)
        rows.append((i, "\n".join([rnd.choice("xyz") for _ in range(rnd.randrange(4))] + base[a:z] + [rnd.choice("xyz") for _ in range(rnd.randrange(4))])))
    got, want = judged(mark(frame(spark, rows))), brute(rows, 2)
    assert got == want
    assert len({n for _, _, n, _ in want.values()}) > 12


def test_sql(spark, rows, tmp_path):
    d = pd.DataFrame(rows + [(900, "\n".join(f"r{j}" for j in range(11))), (901, "x\n" + "\n".join(f"r{j}" for j in range(11)))], columns=["doc_id", "text"])
    d.to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.register("documents", d)
    want = con.execute(oracle.LINES).df().sort_values("doc_id")
    got = op1_line_dedup(spark, str(tmp_path)).toPandas().sort_values("doc_id")[list(want.columns)]
    assert (got.to_numpy() == want.to_numpy()).all()
    assert want.longest_run.max() >= 11


def test_edges(spark):
    t = "a\nb\n\nc"
    rows = [(1, t), (1, t), (2, t), (None, "x\ny"), (3, None), (4, "x\ny"), (1, "other"), (5, "z\na\nb")]
    out = dedup(frame(spark, rows))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in out.collect())
    assert got == [(-1, "x\ny"), (1, t), (1, t), (1, "other"), (3, ""), (5, "z")]
    assert out.columns == frame(spark, rows).columns
    assert dedup(frame(spark, rows).limit(0)).count() == 0


def test_a_very_long_text(spark):
    body = "\n".join(f"line {j}" for j in range(6000))
    got = judged(mark(frame(spark, [(1, body), (2, "own\n" + body)])))
    assert got[1][:3] == (6000, 0, 0) and got[2] == (6001, 6000, 6000, "own")
    assert lines.MIN_LINES == 2
