import math
import re
from collections import Counter

import duckdb
import pandas as pd

from geoloom.llm.licenses import CUE, TEMPLATES, THRESHOLD, op5_license_scans, scan, template_frame, tree

from geoloom.llm import oracle

from .conftest import frame

FILES = [
    (1, "a/LICENSE", "Released under the MIT License."),
    (2, "a/x.txt", "nothing here"),
    (3, "a/b/c/y.txt", None),
    (4, "a/b/LICENSE.md", "Licensed under the Apache License, Version 2.0."),
    (5, "z/q.txt", "text\nThis work is licensed under the GNU General Public License, version 3.\nmore"),
    (6, "z/r.txt", "a licence of no known kind that nobody has seen"),
    (7, None, "Released under the MIT License."),
    (8, None, ""),
    (9, "top.txt", ""),
    (2, "a/x.txt", "nothing here"),
]


def terms(line):
    return Counter(re.findall(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*", line.lower()))


def brute(files):
    """The best template of each file over its lines with a cue and, as a vector of other terms' weights too, its whole text."""
    lines = sorted({(i, x) for i, _, t in files for x in (t or "").split("\n") if re.search(CUE, x)})
    docs = [terms(x) for _, x in lines] + [terms(x) for _, x in TEMPLATES]
    total = len(docs)
    lines += sorted({(i, " ".join(t.split())) for i, _, t in files if re.search(CUE, t or "")})
    df = Counter(t for d in docs for t in d)
    idf = {t: math.log((1 + total) / (1 + df[t])) + 1 for d in docs + [terms(x) for _, x in lines] for t in d}
    vec = lambda d: {t: n * idf[t] for t, n in d.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    own = {}
    for i, x in lines:
        v = vec(terms(x))
        for name, t in TEMPLATES:
            u = vec(terms(t))
            s = round(sum(v[k] * u[k] for k in v if k in u) / (norm(v) * norm(u)), 6)
            if s >= THRESHOLD:
                own[i] = min(own.get(i, (9, "")), (-s, name))
    return own


def test_scan(spark):
    out = scan(spark.createDataFrame(FILES, "id long, path string, text string"), template_frame(spark))
    got = [(r.id, r.license, r.found, r.from_dir) for r in out.collect()]
    assert sorted(got) == sorted(
        [(1, "MIT", "own", None), (2, "MIT", "inherited", "a"), (2, "MIT", "inherited", "a"), (3, "Apache-2.0", "inherited", "a/b"), (4, "Apache-2.0", "own", None), (5, "GPL-3.0", "own", None)]
        + [(6, None, "none", None), (7, "MIT", "own", None), (8, None, "none", None), (9, None, "none", None)]
    )
    own = brute(FILES)
    assert {r.id: (-r.score, r.license) for r in out.collect() if r.found == "own"} == own


def test_edges(spark):
    empty = spark.createDataFrame([], "id long, path string, text string")
    assert scan(empty, template_frame(spark)).count() == 0
    files = spark.createDataFrame(FILES, "id long, path string, text string")
    assert {r.found for r in scan(files, template_frame(spark).limit(0)).collect()} == {"none"}
    assert scan(tree(frame(spark, [(1, "Released under the MIT License."), (None, None)])), template_frame(spark)).count() == 2


def test_no_python(spark):
    plan = op5_license_scans(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_notices_beyond_one_line(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:"
    files = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/x.txt", "some prose\nAll rights reserved.\nmore prose"),
        (3, "b/x.c", "// SPDX-License-Identifier: Apache-2.0\nint x;"),
        (4, "b/y.c", "/*\n * Licensed under the Apache\n * License, Version\n * 2.0.\n */\n\nint y;"),
        (5, "b/z.txt", mit + "\n\nThe rest."),
        (6, "b/w.txt", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"),
        (7, "c/v.c", "# SPDX-License-Identifier: Nobodys-1.0"),
    ]
    got = {r.id: (r.license, r.found) for r in scan(spark.createDataFrame(files, "id long, path string, text string"), template_frame(spark)).collect()}
    own = {1: "MIT", 2: "Proprietary", 3: "Apache-2.0", 4: "Apache-2.0", 5: "MIT", 6: "BSD-3-Clause"}
    assert got == {i: (x, "own") for i, x in own.items()} | {7: (None, "none")}


def test_sql(spark, tmp_path):
    texts = [t for _, _, t in FILES] + ["All rights reserved.", "/*\n * Licensed under the Apache\r\n * License, Version\n * 2.0.\n */\n\nint y;", "prose " * 3000 + "\nReleased under the MIT License."]
    d = pd.DataFrame([(90 * i, t, ("en", None)[i % 2], "s") for i, t in enumerate(texts)] + [(7, "plain", "en", "other")], columns=["doc_id", "text", "lang", "source"])
    d.to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.register("documents", d)
    want = con.execute(oracle.LICENSES).df().sort_values("doc_id")
    got = op5_license_scans(spark, str(tmp_path)).toPandas().sort_values("doc_id")[list(want.columns)]
    assert got.fillna("-").to_numpy().tolist() == want.fillna("-").to_numpy().tolist()
    assert {"own", "inherited", "none"} == set(want.found)


def test_extra_columns(spark):
    d = frame(spark, [(1, "Released under the MIT License."), (2, "x " * 100_000)])
    assert sorted((r.id, r.found) for r in scan(d.selectExpr("doc_id AS id", "'a/b' AS path", "text", "class AS license", "key AS own", "row AS kind"), template_frame(spark)).collect()) == [(1, "own"), (2, "inherited")]
