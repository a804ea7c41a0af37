"""The corpus pipeline: five stages of quillmere.llm operators, each written as Parquet and reread.

toxicity and quality rules drop what they reject, the n-gram join keeps one document of each group,
decontamination drops documents with a benchmark window, packing lays out what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmere.llm import decontaminate, jaccard_join, packing, quality_rules, tokens, toxicity
from quillmere.llm.common import dropped, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labels, as no label is held out here, and drops documents that score 0.5 or more."""
    rows = toxicity.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = toxicity.train(rows)
    dropped(rows)
    return toxicity.clean_documents(docs, model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base or the repetition rules; null and empty texts fail."""
    return quality_rules.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; the least id of a group stays."""
    return jaccard_join.keep_one(docs, size=5, percent=80).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a ten-word window of a benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lays out what is left in sequences of 4,096 tokens; a row a piece."""
    return packing.pack_documents(docs, tokens.vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: SQL can't express the learned weights of the first stage; tests hold each stage and the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table is written and reread as the next one's documents, and dropped once that one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        dropped(before)
    return docs
