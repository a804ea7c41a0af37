"""The registered queries of this subpackage: op1_ to op10_, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitpack, compaction, decontaminate, html_mincut, jaccard_join, packing, quality_rules, token_counts, tokens, tool_links, toxicity
from .common import dropped


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(_table(spark, sf_dir, "documents"))
    return out.drop("spans", "longest_repeat")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), size=3, percent=90)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = toxicity.training_rows(docs, _table(spark, sf_dir, "labels"), hold_out=True)
    out = toxicity.score(docs, toxicity.train(rows))
    dropped(rows)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))  # a null id is never learned from, nor held out
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op6_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = compaction.sharded(_table(spark, sf_dir, "documents"))
    return store.read().select("doc_id", "lang", "source", F.length("text").cast("long").alias("n_chars"), F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.token_files(_table(spark, sf_dir, "documents"), tokens.vocabulary_path())


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokens.vocabulary_path())


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mincut.extract_main_text(_table(spark, sf_dir, "pages"))


def op10_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_links.formatted_conversations(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality_rules, op2_ngram_jaccard, op3_token_counts, op4_toxicity, op5_decontamination, op6_compaction, op7_token_files, op8_packing, op9_main_text, op10_tool_links]
    return {f.__name__: f for f in found}
