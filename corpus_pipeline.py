"""From raw documents to token ids: the stages of the corpus pipeline.

A stage takes (spark, docs, sf_dir) and returns the documents that it keeps; all but the last
return the columns of ``documents``.  ``run`` writes each stage's result as Parquet in the shared
checkpoint folder and reads it again as the next one's input, so a lost executor costs no more
than the stage under way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from geoloom.functions.checkpoints import remove, shared_folder
from geoloom.llm import decontaminate, lines, ngram_join, quality, sentencepiece

#: Words of a shingle and per cent of similarity of near duplicates.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the threshold table; null and empty texts go, repeated rows are judged alike."""
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; so does a document of which nothing is left.

    Earlier is by (doc_id, line), a null doc_id first; repeated rows of the first document all stay.
    """
    return lines.dedup(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id; a text without words is in no group.

    Repeated rows are copies: one stays.
    """
    return ngram_join.representatives(docs, NEAR_WORDS, NEAR_PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item; an empty benchmark is leaked by none, and a document with a null id goes with any other of a null id that leaks."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids and the text that these decode to; a null text has the end id alone."""
    return sentencepiece.tokenized(docs, sentencepiece.model_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]

#: SQL can't express edit distance over words or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
