"""URL filters: a blocked Bloom filter before an exact hash join (operator 2).

A rule is a host and a path prefix; it fits its host and all subdomains.  Rules and listed URLs
become canonical keys (host suffix + path prefix).  A distinct address first probes its host and the
parents of this in a blocked Bloom filter of listed hosts, then, below possible ones, the keys
with paths of the lengths that occur in a filter of listed keys; only possible hits go to a hash
join with the exact keys, which removes false positives.  The longest rule wins; among rules of one length the longer host, then
block over allow.

Each filter has the same size whatever the lists' size (32 MB), so what is broadcast is bounded;
one that is too full only lets more rows through to the join.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no
rule; a rule's path must be a prefix of the url's, so an empty path fits none.  Repeated pages
are judged separately.  Empty lists leave every page to the default verdict.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import bloom

#: (verdict, host, path prefix)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Listed canonical URLs (advertising, betting, pharmacy, spam and adult hosts): blocked where no rule fits.
LISTED = (
    ("ads-track.example.com", "/"),
    ("free-bets.example.net", "/"),
    ("cheap-pills.example.net", "/"),
    ("spam-farm.example.org", "/"),
    ("casino-win.example.net", "/"),
    ("adult-x.example.com", "/"),
)

def address(url: Column) -> tuple[Column, Column]:
    """Canonical host and path."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, listed for each row of pages.

    rules: verdict, host, path; listed: host, path.
    """
    spark = pages.sparkSession
    host, path = address(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    r = rules.where("host IS NOT NULL AND path IS NOT NULL").select(F.concat("host", "path").alias("key"), "host", "path", "verdict")
    x = listed.where("host IS NOT NULL AND path IS NOT NULL").select(F.concat("host", "path").alias("key"), "host", "path", F.lit(None).cast("string").alias("verdict"))
    keys = r.unionByName(x).distinct()
    # Path lengths of the keys by labels of their hosts; at most the lists' longest path a label.
    lengths: dict[int, list[int]] = {}
    for r in keys.select(F.size(F.split("host", r"\.")).alias("n"), F.length("path").alias("m")).distinct().orderBy("n", "m").toLocalIterator():
        lengths.setdefault(r.n, []).append(r.m)
    send = spark.sparkContext.broadcast
    host_bits = send(bloom.build(keys.select(F.xxhash64("host").alias("h")).distinct()))
    key_bits = send(bloom.build(keys.select(F.xxhash64("key").alias("h"))))

    def possible(bits):
        def run(batches):
            for b in batches:
                yield b.filter(pa.array(bloom.possible(bits.value, np.asarray(b.column("h")))))

        return run

    # First the host and its parents, then, below those that may be listed, the paths of the lengths that occur.
    labels = F.filter(F.array(*[F.lit(n) for n in lengths] or [F.lit(None).cast("int")]), lambda n: n <= F.size(F.split("host", r"\.")))
    hosts = rows.where("host <> ''").select("host", "path").distinct().select("host", "path", F.explode(labels).alias("n"))
    hosts = hosts.withColumn("suffix", F.array_join(F.slice(F.split("host", r"\."), -F.col("n"), F.col("n")), ".")).withColumn("h", F.xxhash64("suffix"))
    hosts = hosts.mapInArrow(possible(host_bits), "host string, path string, n int, suffix string, h long")
    of = F.coalesce(*[F.when(F.col("n") == n, F.array(*[F.lit(m) for m in ms])) for n, ms in lengths.items()], F.array().cast("array<int>"))
    probes = hosts.select("host", "path", "suffix", F.explode(F.filter(of, lambda m: m <= F.length("path"))).alias("m"))
    probes = probes.select("host", "path", F.concat("suffix", F.substring("path", F.lit(1), F.col("m"))).alias("key"))
    found = probes.withColumn("h", F.xxhash64("key")).mapInArrow(possible(key_bits), "host string, path string, key string, h long")
    exact = found.drop("h").join(keys.select("key", F.length("host").alias("n"), "verdict"), "key")
    best = F.struct(F.length("key").alias("len"), "n", F.when(F.col("verdict") == "block", 1).otherwise(0).alias("b"), "key", "verdict")
    won = exact.groupBy("host", "path").agg(F.max(F.when(F.col("verdict").isNotNull(), best)).alias("won"), F.max(F.col("verdict").isNull()).alias("listed"))
    out = rows.join(won, ["host", "path"], "left")
    is_listed = F.coalesce(F.col("listed"), F.lit(False))
    verdict = F.coalesce(F.col("won.verdict"), F.when(is_listed, F.lit("block")), F.lit(default))
    return out.select("page_id", "host", "path", F.col("won.key").alias("rule"), verdict.alias("verdict"), is_listed.alias("listed"))


def frames(spark: SparkSession, rules=RULES, listed=LISTED) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string"), spark.createDataFrame(list(listed), "host string, path string")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), *frames(spark))
