"""The training-data pipeline: stages over documents, each written and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sitelens.llm import jaccard, packing, quality, suffixes, toxicity
from sitelens.llm.common import shared_root, ship, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents whose toxicity score reaches the threshold go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that importance resampling does not draw go."""
    return quality.keep_selected(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each component of linked documents the smallest doc_id stays."""
    ship(spark)
    return jaccard.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: passages that start in a document with a smaller id are cut from the text."""
    ship(spark)
    return suffixes.deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the kept texts as pieces of training sequences."""
    ship(spark)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return packing.packed(docs, f.read())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_array", cut_repeats),
    ("packing", pack),
]
# Learnt scores, suffix arrays and tokens are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_root(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
