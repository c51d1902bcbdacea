"""Line dedup by a suffix array over line-ID sequences (operator 1).

A document is its sequence of lines with a word.

1. Prefix doubling: round k names every run of ``2**k`` lines that occurs more than once by the
   coordinate of its first occurrence.  A run's name is made of those of its two halves, so a
   round is one join by place and one aggregation by name.  Suffixes with one name are an
   interval of the suffix array whose longest common prefix is ``2**k`` at least; suffixes that
   are alone leave, and the rounds end when none is left.
2. Longest common prefixes: intervals are split from the longest powers down.  An interval of
   prefix n is split by the names of ``2**k`` lines that follow its n lines; each part is an
   interval of prefix ``n + 2**k``, and in the interval itself the first suffix stands for the
   whole part.  After the last power the longest interval in which a suffix isn't the first is
   the longest run that begins there and also begins earlier, exactly.
3. A run counts if it has ``min_lines`` lines; the maximal runs of a document are where this
   length doesn't just go on from the line before.  What they cover goes, and so does a single
   later line of ``min_words`` words.

Lines are compared by 128 bits of hash, runs by their names.  The rounds carry repeated lines
only; a line that a third of the corpus repeats is pre-aggregated before the shuffle by name,
and its occurrences meet the name in several tasks.

Defined results: blank lines are in no run and stay; a null or empty text has no lines and
becomes empty; of runs with equal coordinates none is earlier, so repeated rows of a first
document all stay; rows that share a doc_id with other texts are separate; a null doc_id comes
first.  ``dedup`` keeps the other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm.components import checkpoint

MIN_LINES = 2
#: Words from which on a later copy of a single line goes too.
MIN_WORDS = 20
SPACES = " \t\n\x0b\x0c\r"
NULL_ID = -(1 << 63)
KEY = ["doc", "part"]


def _keys(docs: DataFrame) -> tuple[list, bool]:
    shared = bool(docs.groupBy("doc_id").count().where("count > 1").limit(1).count())
    part = F.xxhash64("text") if shared else F.lit(0).cast("long")
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), part.alias("part")], shared


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """doc, part, pos, at, x, y: the place of each line with a word in its sequence and in its text; long where it has the characters of min_words words."""
    keys, shared = _keys(docs)
    d = docs.select(*keys, F.coalesce("text", F.lit("")).alias("text"))
    if shared:
        d = d.dropDuplicates(KEY)
    each = F.transform(
        F.split("text", "\n", -1),
        lambda l, i: F.struct(i.alias("at"), F.xxhash64(l).alias("x"), F.xxhash64(F.lit(1), l).alias("y"), (F.translate(l, SPACES, "") != "").alias("word"), (F.length(l) >= 2 * min_words - 1).alias("long")),
    )
    return d.select(*KEY, F.posexplode(F.filter(each, lambda s: s["word"])).alias("pos", "s")).select(*KEY, "pos", "s.at", "s.long", "s.x", "s.y")


#: Rows of a task; small rounds are gathered in few tasks, or each would write a file for every partition.
TASK_ROWS = 100_000


def _tasks(rows: int) -> int:
    return max(2, -(-rows // TASK_ROWS))


def _named(rows: DataFrame, by: list[str], tasks: int | None = None) -> DataFrame:
    """doc, part, pos and the name (n1, n2, n3) of rows that share ``by`` with others."""
    heads = rows.groupBy(*by).agg(F.min(F.struct(*KEY, "pos")).alias("head"), F.count(F.lit(1)).alias("of")).where("of > 1")
    heads = heads.select(*[F.col(c).alias(f"_{c}") for c in by], "head")
    same = [F.col(c) == F.col(f"_{c}") for c in by]
    out = rows.join(heads.coalesce(tasks) if tasks else heads, same)
    out = out.coalesce(tasks) if tasks else out
    return out.select(*KEY, "pos", F.col("head.doc").alias("n1"), F.col("head.part").alias("n2"), F.col("head.pos").alias("n3"))


#: A line with over one in so many of all repeated ones is common, so there are less than this many.
COMMON = 1000
SALTS = 64


def _named_lines(rows: DataFrame) -> DataFrame:
    """As ``_named`` by (x, y); the occurrences of common lines meet their names in SALTS tasks each."""
    by = ["x", "y"]
    heads = checkpoint(rows.groupBy(*by).agg(F.min(F.struct(*KEY, "pos")).alias("head"), F.count(F.lit(1)).alias("of")).where("of > 1"))
    total = heads.agg(F.sum("of")).first()[0] or 0
    often = F.col("of") > max(16, total // COMMON)
    some = F.broadcast(heads.where(often).select(*[F.col(c).alias(f"c{c}") for c in by]))
    rows = rows.join(some, (F.col("x") == F.col("cx")) & (F.col("y") == F.col("cy")), "left")
    rows = rows.withColumn("salt", F.when(F.col("cx").isNotNull(), F.pmod(F.xxhash64(*KEY, "pos"), F.lit(SALTS))).otherwise(0).cast("int")).drop("cx", "cy")
    salts = F.when(often, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    heads = heads.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("head"), F.explode(salts).alias("_salt"))
    out = rows.join(heads, [*[F.col(c) == F.col(f"_{c}") for c in by], F.col("salt") == F.col("_salt")])
    return out.select(*KEY, "pos", "at", "long", F.col("head.doc").alias("n1"), F.col("head.part").alias("n2"), F.col("head.pos").alias("n3"))


def _paired(names: DataFrame, step: int) -> DataFrame:
    """Names of a run and of the one that begins ``step`` lines further on."""
    right = names.select(*KEY, (F.col("pos") - step).alias("pos"), F.col("n1").alias("m1"), F.col("n2").alias("m2"), F.col("n3").alias("m3"))
    return names.select(*KEY, "pos", *_NAME).join(right, [*KEY, "pos"])


_NAME = ["n1", "n2", "n3"]
_NEXT = ["m1", "m2", "m3"]


def _later(names: DataFrame) -> DataFrame:
    """Runs that also begin at a smaller (doc, line)."""
    return names.where("doc <> n1 OR pos <> n3")


def intervals(first: DataFrame) -> tuple[list[DataFrame], list[int]]:
    """Names of the repeated runs of 1, 2, 4, ... lines, as long as there are any, and how many."""
    levels, rows = [first], [first.count()]
    while rows[-1]:
        tasks = _tasks(rows[-1])
        pairs = _paired(levels[-1], 1 << (len(levels) - 1)).coalesce(tasks)
        levels.append(checkpoint(_named(pairs, _NAME + _NEXT, tasks)))
        rows.append(levels[-1].count())
    return levels[:-1], rows[:-1]


def _split(members: DataFrame, names: DataFrame, power: int, tasks: int) -> DataFrame:
    """Members (place, interval's name and prefix n) and those of the parts by the ``power`` lines that follow the n."""
    follow = names.select(*KEY, F.col("pos").alias("next"), *[F.col(a).alias(b) for a, b in zip(_NAME, _NEXT, strict=True)])
    rows = members.withColumn("next", F.col("pos") + F.col("n")).join(follow, [*KEY, "next"], "left").coalesce(tasks)
    by = [*_NAME, "n", *_NEXT]
    parts = rows.where("m1 IS NOT NULL").groupBy(*by).agg(F.min(F.struct(*KEY, "pos")).alias("head"), F.count(F.lit(1)).alias("of")).where("of > 1")
    parts = parts.select(*[F.col(c).alias(f"_{c}") for c in by], "head").coalesce(tasks)
    rows = rows.join(parts, [F.col(c) == F.col(f"_{c}") for c in by], "left").coalesce(tasks)
    alone = F.col("head").isNull()
    is_head = F.struct(*KEY, "pos") == F.col("head")
    stay = F.struct(*_NAME, "n")
    part = F.struct(F.col("head.doc").alias("n1"), F.col("head.part").alias("n2"), F.col("head.pos").alias("n3"), (F.col("n") + power).alias("n"))
    both = F.when(alone, F.array(stay)).when(is_head, F.array(stay, part)).otherwise(F.array(part))
    return rows.select(*KEY, "pos", F.explode(both).alias("i")).select(*KEY, "pos", "i.*")


def longest_runs(levels: list[DataFrame], rows: list[int]) -> DataFrame | None:
    """doc, part, pos, length: the longest run that begins there and also earlier, where it has two lines or more."""
    members, size = None, 0
    for k in range(len(levels) - 1, 0, -1):
        names = levels[k]
        if members is not None:
            members = checkpoint(_split(members, names, 1 << k, _tasks(size)))
            size = members.count()
            upper = _later(levels[k + 1]).select(*KEY, "pos")
            names = names.join(upper, [*KEY, "pos"], "left_anti").coalesce(_tasks(rows[k]))
        new = names.select(*KEY, "pos", *_NAME, F.lit(1 << k).alias("n"))
        members = new if members is None else members.unionAll(new)
        size += rows[k]
    if members is None:
        return None
    members = _split(members, levels[0], 1, _tasks(size))
    return _later(members).groupBy(*KEY, "pos").agg(F.max("n").alias("length"))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(doc, part, at, single) of the lines to delete, single ones if they have min_words words; (doc, part, longest): lines of the longest repeated run from min_lines on."""
    first = checkpoint(_named_lines(_lines(docs, min_words)))
    lengths = longest_runs(*intervals(first))
    single = _later(first).where("long").select(*KEY, "at", F.lit(True).alias("single"))
    if min_lines < 2:
        single = _later(first).select(*KEY, "at", F.lit(False).alias("single"))
    if lengths is None:
        return single, first.where("false").select(*KEY, F.lit(1).alias("longest"))
    lengths = checkpoint(lengths.where(F.col("length") >= max(2, min_lines)))
    # A run that only goes on from the line before adds no line.
    before = F.lag(F.col("pos") + F.col("length")).over(Window.partitionBy(*KEY).orderBy("pos"))
    runs = lengths.select(*KEY, F.greatest("pos", F.coalesce(before, "pos")).alias("from"), (F.col("pos") + F.col("length") - 1).alias("to")).where("from <= to")
    spread = runs.select(*KEY, F.explode(F.sequence("from", "to")).alias("pos"))
    covered = spread.join(first.select(*KEY, "pos", "at"), [*KEY, "pos"]).select(*KEY, "at", F.lit(False).alias("single"))
    return covered.unionAll(single), lengths.groupBy(*KEY).agg(F.max("length").alias("longest"))


def mark(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of docs in a struct ``row``, the kept text, n_lines, n_removed, longest."""
    covered, longest = repeated_runs(docs, min_lines, min_words)
    gone = covered.groupBy(*KEY).agg(F.collect_list(F.struct("at", "single")).alias("gone")).join(longest, KEY, "left")
    keys, _ = _keys(docs)
    rows = docs.select(*keys, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    j = rows.join(gone, KEY, "left")
    lines = F.split(F.coalesce("row.text", F.lit("")), "\n", -1)
    words = lambda l: F.size(F.filter(F.split(l, "[ \t\x0b\x0c\r]+"), lambda w: w != ""))
    # The array is bound once: lines of a text that lose some.
    bound = lambda f: F.transform(F.array(lines), f)[0]
    places = lambda a: F.array_distinct(F.transform(F.filter("gone", lambda g: ~g["single"] | (words(F.get(a, g["at"])) >= min_words)), lambda g: g["at"]))
    j = j.select("row", "longest", F.when(F.col("gone").isNull(), F.array().cast("array<int>")).otherwise(bound(places)).alias("gone"))
    kept = lambda a: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col("gone")), lambda i: F.get(a, i)), "\n")
    text = F.when(F.size("gone") == 0, F.coalesce("row.text", F.lit(""))).otherwise(bound(kept))
    n = F.size(F.filter(lines, lambda l: F.translate(l, SPACES, "") != "")).cast("long")
    return j.select("row", text.alias("kept_text"), n.alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), F.coalesce("longest", F.lit(0)).alias("longest"))


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the kept text; documents that lose all their lines go."""
    m = mark(docs, min_lines, min_words).where("n_removed = 0 OR n_removed < n_lines")
    return m.select(*[F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text")).alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mark(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return m.select("row.doc_id", "n_lines", "n_removed", F.col("longest").cast("long").alias("longest_run"), F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
