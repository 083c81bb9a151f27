"""The corpus pipeline: documents in, token ids of the documents worth training on out.

Each stage works on everything that the one before it kept, and its result is written before the next one starts, so
that a lost executor costs tasks of one stage only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparrowtext.llm import bpe, decontaminate, jaccard, line_dedup, quality_crf
from sparrowtext.llm._spark import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field rejects go, those without lines among them."""
    return quality_crf.without_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copied lines go, and documents of which nothing else is left; near copies of whole documents are left to the next stage."""
    return line_dedup.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The earliest document of each group of similar ones stays."""
    return jaccard.one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of each document."""
    return bpe.encoded(docs, bpe.default_vocabulary())


STAGES = [("quality_crf", quality), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("decontaminate", leaks), ("bpe", tokens)]

#: The marginals of a fitted field and byte-pair merges are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; the results in between are written to the shared folder."""
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
