"""Quality rules: a threshold table compiled into one Spark projection (operator 4).

Every statistic is a Catalyst expression over the whole text; nothing leaves the JVM and there
is no shuffle, so a partition's memory is bounded by its longest text.

Defined results: a null text counts as an empty one (no words, fails the base rules); repeated
rows are judged separately; other columns of the input are passed through ``filter_documents``
untouched whatever their names, and ``measure`` keeps only ``doc_id``.  Repeated three-word
windows are recognised by their 64-bit hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Function words of the four corpus languages.
STOP_WORDS = (
    "the be to of and that have with in is it for as was this from "
    "der die und das von den mit ist im sich nicht ein eine zu "
    "de la le les et des en un une que du est pour "
    "el los las y del se por con una su para"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if ``100 * top <= most * bottom`` and ``100 * top >= least * bottom``."""

    name: str
    top: str
    bottom: str
    least: int | None = None
    most: int | None = None


#: name, statistic, its base, least and most per cent.
RULES = (
    Rule("mean_word_length_low", "word_chars", "n_words", least=200),
    Rule("mean_word_length_high", "word_chars", "n_words", most=2000),
    Rule("symbol_ratio", "n_symbols", "n_words", most=20),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", most=60),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines", "n_lines", most=30),
    Rule("bullet_line_ratio", "n_bullet_lines", "n_lines", most=90),
    Rule("stop_word_ratio", "n_stop_words", "n_words", least=5),
)

MIN_WORDS = 50
MAX_REPEAT = 50


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once, though the body uses it often."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that are found twice or more in the text."""

    def of_sorted(a: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(a, j)["h"] == x["h"], F.lit(False))
        starts = F.array_sort(F.transform(F.filter(a, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
        first = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        add = lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last"))
        return F.aggregate(starts, first, add, lambda s: s["n"].cast("long"))

    def of_hashes(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(F.array_sort(pairs), of_sorted))

    windows = F.transform(F.slice(words, 3, F.greatest(F.size(words), F.lit(0))), lambda w, i: F.xxhash64(F.get(words, i), F.get(words, i + 1), w))
    return let(windows, of_hashes)


def _lines(text: Column) -> Column:
    """Counts over the lines that hold a word."""

    def of(lines: Column) -> Column:
        count = lambda test: F.size(F.filter(lines, test)).cast("long")
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            count(lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")).alias("n_ellipsis_lines"),
            count(lambda x: F.ltrim(x).rlike(r"^[•\-\*]\s")).alias("n_bullet_lines"),
        )

    return let(F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != ""), of)


def statistics(text: Column) -> Column:
    """One struct of all statistics of a text."""
    whole = F.coalesce(text, F.lit(""))

    def of(words: Column) -> Column:
        bare = lambda w: F.translate(F.lower(w), ".,;:!?", "")
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            _repeat_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: (F.length(w) <= 6) & bare(w).isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
        )

    return F.struct(
        let(F.filter(F.split(whole, SPLIT), lambda w: w != ""), of).alias("w"),
        _lines(whole).alias("l"),
        F.length(F.translate(whole, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )


def compile_rules(rules=RULES, value=F.col) -> Column:
    """The names of the rules that a row of statistics fails, as one array expression; value gives a statistic by name."""
    failed = []
    for r in rules:
        top, bottom = 100 * value(r.top), value(r.bottom)
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (top < r.least * bottom)
        if r.most is not None:
            bad = bad | (top > r.most * bottom)
        failed.append(F.when(bad, F.lit(r.name)))
    return F.filter(F.array(*failed), lambda x: x.isNotNull())


def _base_failed(min_words: int, max_repeat: int, value=F.col) -> Column:
    return (value("n_words") < min_words) | (100 * value("n_repeat_words") > max_repeat * value("n_words"))


def measure(docs: DataFrame, rules=RULES, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """doc_id, the statistics, base_failed, the failed rules and kept, a row per input row."""
    s = docs.select("doc_id", statistics(F.col("text")).alias("s"))
    s = s.select("doc_id", "s.w.*", "s.l.*", "s.word_chars", "s.n_symbols")
    s = s.select("*", _base_failed(min_words, max_repeat).alias("base_failed"), compile_rules(rules).alias("failed_rules"))
    return s.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def passes(text: Column, rules=RULES, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT) -> Column:
    """Whether a text passes, as one expression.

    The statistics are bound to a variable: as columns of a subquery they would be pulled into
    a filter, and computed anew wherever it names one.
    """

    def judged(s: Column) -> Column:
        value = lambda n: s[n] if n in ("word_chars", "n_symbols") else s["l"][n] if "_line" in n else s["w"][n]
        return ~_base_failed(min_words, max_repeat, value) & (F.size(compile_rules(rules, value)) == 0)

    return let(statistics(text), judged)


def filter_documents(docs: DataFrame, rules=RULES) -> DataFrame:
    """The documents that pass, with all their columns."""
    return docs.where(passes(F.col("text"), rules))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return measure(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
