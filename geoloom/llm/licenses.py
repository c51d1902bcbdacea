"""License scans: sparse TF-IDF cosine to templates, then inheritance by directory (operator 5).

Vectors are the notices of a file that holds a cue word: each line with one, each paragraph of
several lines with one as a whole (so wrapped headers and licence texts), and the whole text.
Notices and templates are vectors of lower-cased words weighted by term count times
``ln((1 + N) / (1 + df)) + 1``, with N and df over all lines with a cue and templates; a file's
own licence is the best template over its notices, from ``THRESHOLD`` on.  Cue words only choose
what becomes a vector; the cosine decides.

A licence file is one with a licence of its own that is named like one, or whose whole text is
similar to a template from ``FILE_THRESHOLD`` on.  A file without a licence inherits from the nearest directory above it that has
a licence file: its directories are joined to the licences of directories by path.  Everything is
DataFrame expressions.  Texts are read once; notices are checkpointed and templates meet them by
term, so shuffles carry notices only.

Defined results: null texts and paths have no notice and nothing to inherit; a licence file's
directory is where it lies, the best score wins among several in one directory, then the smaller
path; equal scores of templates are settled by name.  Files are known by ``id``; repeated rows
with one id are one file's notices together and come back as often as they came.  Other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.checkpoints import checkpoint

THRESHOLD = 0.6
#: From which similarity of a whole text on it is a licence file, whatever its name.
FILE_THRESHOLD = 0.9
_CUES = ("licen[cs]e[ds]?", "copyright", "spdx-license-identifier", "public domain", "rights reserved", "permission is hereby granted", "redistribution and use")


def cue(gap: str = " ") -> str:
    """Pattern of the cue words, with gap between those of one cue; no look-around, so that SQL can share it."""
    return f"(?i)(?:^|[^a-z0-9_])(?:{'|'.join(c.replace(' ', gap) for c in _CUES)})(?:$|[^a-z0-9_])"


CUE = cue()
SPACE = r"[ \t\n\x0B\f\r]"
#: The signs of comments before a line.
SIGNS = r"^[ \t]*(?:/\*+|\*+/|\*|//+|#+|--+|;+)?[ \t]*"
BLANK = rf"\n{SPACE}*\n"
WRAPPED = rf"[^ \t\n\x0B\f\r][ \t]*\n{SPACE}*[^ \t\n\x0B\f\r]"
TERM = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
LINE, PARAGRAPH, TEXT = range(3)

#: Ids that SPDX tags name, by the licence they stand for.
SPDX = (
    ("MIT", "MIT"),
    ("Apache-2.0", "Apache-2.0"),
    ("GPL-3.0", "GPL-3.0"),
    ("GPL-3.0", "GPL-3.0-only"),
    ("GPL-3.0", "GPL-3.0-or-later"),
    ("GPL-2.0", "GPL-2.0"),
    ("GPL-2.0", "GPL-2.0-only"),
    ("GPL-2.0", "GPL-2.0-or-later"),
    ("LGPL-3.0", "LGPL-3.0"),
    ("LGPL-3.0", "LGPL-3.0-only"),
    ("LGPL-3.0", "LGPL-3.0-or-later"),
    ("MPL-2.0", "MPL-2.0"),
    ("BSD-3-Clause", "BSD-3-Clause"),
    ("CC-BY-4.0", "CC-BY-4.0"),
    ("CC-BY-SA-4.0", "CC-BY-SA-4.0"),
    ("CC-BY-NC-4.0", "CC-BY-NC-4.0"),
    ("CC0-1.0", "CC0-1.0"),
    ("Unlicense", "Unlicense"),
)

#: Public notices: short ones, the first paragraphs of headers and licence texts, and SPDX tags.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style 3-clause license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
) + tuple((name, f"SPDX-License-Identifier: {tag}") for name, tag in SPDX)


def _terms(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(TERM), F.lit(0))


def notices(files: DataFrame) -> DataFrame:
    """id, kind, line, x, y (the line's hash): the vectors of files that hold a cue word; equal ones of a file once."""
    some = files.where(F.col("text").rlike(cue("[^a-z0-9_]+")))
    text = F.regexp_replace("text", r"\r\n?", "\n")
    # A paragraph ends at a blank line; the signs of comments before its lines go.
    plain = F.regexp_replace(text, f"(?dm){SIGNS}", "")
    flat = lambda p: F.regexp_replace(p, f"{SPACE}+", " ")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(CUE))
    wrapped = F.filter(F.transform(F.filter(F.split(plain, BLANK, -1), lambda p: p.rlike(WRAPPED)), flat), lambda p: p.rlike(CUE))
    tagged = lambda a, kind: F.transform(F.array_distinct(a), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("line")))
    each = F.concat(tagged(lines, LINE), tagged(wrapped, PARAGRAPH), tagged(F.array(flat(plain)), TEXT))
    return some.select("id", F.explode(each).alias("n")).select("id", "n.kind", "n.line", F.xxhash64("n.line").alias("x"), F.xxhash64(F.lit(1), "n.line").alias("y"))


def scores(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """x, y, kind, license, score: the best template of each distinct notice; weights follow lines and templates."""
    key = ["x", "y", "kind"]
    distinct = lines.groupBy(*key).agg(F.count(F.lit(1)).alias("weight"), F.first("line").alias("line"))
    terms = distinct.select(*key, "weight", F.explode(_terms(F.col("line"))).alias("term")).groupBy(*key, "weight", "term").agg(F.count(F.lit(1)).alias("tf"))
    terms = checkpoint(terms)
    t_terms = templates.select("license", F.col("text").alias("of"), F.explode(_terms(F.col("text"))).alias("term")).groupBy("license", "of", "term").agg(F.count(F.lit(1)).alias("tf"))
    # One number: how many lines and templates there are.
    total = lines.where(F.col("kind") == LINE).count() + templates.count()
    counted = terms.where(F.col("kind") == LINE).select("term", "weight")
    df = counted.unionAll(t_terms.select("term", F.lit(1).cast("long"))).groupBy("term").agg(F.sum("weight").alias("df"))
    # Terms of no line or template are in vectors of paragraphs and texts only.
    weight = F.log((1.0 + total) / (1 + F.coalesce("df", F.lit(0)))) + 1
    a = terms.join(df, "term", "left").select(*key, "term", (F.col("tf") * weight).alias("w"))
    b = t_terms.join(df, "term", "left").select("license", "of", "term", (F.col("tf") * weight).alias("v"))
    norms = a.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    t_norms = b.groupBy("license", "of").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("t_norm"))
    dots = a.join(b, "term").groupBy(*key, "license", "of").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = dots.join(norms, key).join(t_norms, ["license", "of"]).select(*key, "license", F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 6).alias("score"))
    best = cosine.groupBy(*key).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select(*key, F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def _above(path: Column) -> Column:
    """The directories of a path, the nearest first; the root is the empty path."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    return F.transform(F.sequence(depth, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(files: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, path, license, score, found (own, inherited or none), from_dir of each file (id, path, text)."""
    found = checkpoint(notices(files.select("id", "text")))
    best = found.drop("line").join(scores(found, templates), ["x", "y", "kind"]).where(F.col("score") >= threshold)
    own = best.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"), F.max((F.col("kind") == TEXT) & (F.col("score") >= FILE_THRESHOLD)).alias("whole"))
    own = checkpoint(own.select(F.col("id").alias("own_id"), F.col("b.license").alias("own"), (-F.col("b.s")).alias("own_score"), "whole"))
    base = files.select("id", "path").join(own, F.col("id").eqNullSafe(F.col("own_id")), "left").drop("own_id")

    name = F.element_at(F.split("path", "/"), -1)
    is_file = F.col("own").isNotNull() & (name.rlike(LICENSE_FILE) | F.col("whole"))
    dirs = base.where(is_file & F.col("path").isNotNull()).groupBy(_above(F.col("path"))[0].alias("dir")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own")).alias("b"))
    dirs = dirs.select("dir", F.col("b.own").alias("dir_license"), (-F.col("b.s")).alias("dir_score"))

    # Directories, not files, look for the nearest licence: many files share one directory.
    need = base.where("path IS NOT NULL").select(_above(F.col("path"))[0].alias("home")).distinct()
    up = need.select("home", F.posexplode(_above(F.concat("home", F.lit("/x"))))).withColumnRenamed("col", "dir")
    up = up.withColumn("dir", F.when(F.col("home") == "", F.lit("")).otherwise(F.col("dir")))
    near = up.join(dirs, "dir").groupBy("home").agg(F.min(F.struct("pos", "dir", "dir_license", "dir_score")).alias("n"))
    out = base.withColumn("home", _above(F.col("path"))[0]).join(near, "home", "left")
    license_ = F.coalesce("own", "n.dir_license")
    return out.select(
        "id",
        "path",
        license_.alias("license"),
        F.coalesce("own_score", "n.dir_score").alias("score"),
        F.when(F.col("own").isNotNull(), "own").when(license_.isNotNull(), "inherited").otherwise("none").alias("found"),
        F.when(F.col("own").isNull(), F.col("n.dir")).alias("from_dir"),
    )


def template_frame(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in templates) + " AS t(license, text)")


def tree(docs: DataFrame) -> DataFrame:
    """The corpus as files: source/lang/shard/doc_id.txt, a thousand ids a shard."""
    folder = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    shard = F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("null"))
    return docs.select(F.col("doc_id").alias("id"), F.concat(folder, F.lit("/"), shard, F.lit("/"), key, F.lit(".txt")).alias("path"), "text")


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(tree(docs), template_frame(spark)).withColumnRenamed("id", "doc_id")
