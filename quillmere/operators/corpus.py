"""Document metadata, summaries, incremental maintenance, quality gates and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Words that are no concepts.
STOPWORDS = (
    "the and for with that from this were have been into over each such within which their through your about shall should could would there these those "
    "when where while against under above below after before between among using used based other than also only both per case cases include includes including"
).split()

#: Words that a table lookup leaves out.
TABLE_STOPWORDS = "the a an and or but in on at to for of with by from as is was are were be been being".split()


def concepts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pool: int = 16, top: int = 8) -> DataFrame:
    """(doc_id, concepts): of the pool most frequent words (three characters or more, no stop words; ties by first
    place), the first top, each cut to 48."""
    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"([a-z][a-z0-9_\-/]{2,})"), F.lit(1))
    counted = docs.select(id_col, F.posexplode(words).alias("pos", "word")).where(~F.col("word").isin(STOPWORDS)).groupBy(id_col, "word").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    w = Window.partitionBy(id_col).orderBy(F.desc("n"), "pos")
    best = counted.withColumn("k", F.row_number().over(w)).where(F.col("k") <= min(pool, top))
    return best.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: F.substring(x["word"], 1, 48)).alias("concepts"))


def summary(value: Column) -> Column:
    return F.substring(F.translate(F.trim(value), "\n", " "), 1, 320)


def quality_score(has_summary: Column, n_concepts: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.when(has_summary, 0.4).otherwise(0.0) + F.least(F.lit(0.4), 0.05 * n_concepts) + 0.2), 3)


def section_summaries(chunks: DataFrame, keys: list[str], order: str, text_col: str = "text", limit: int = 600) -> DataFrame:
    """A concise summary of each section: its chunks' texts in order, joined by spaces, cut at sentences."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text_col))), lambda x: x[text_col]), " ")
    return chunks.groupBy(*keys).agg(joined.alias("_t"), F.count("*").alias("n_chunks")).select(*keys, text.concise(F.col("_t"), limit).alias("summary"), "n_chunks")


def changed(files: DataFrame, index: DataFrame, key: str = "doc_id") -> DataFrame:
    """files with state new, changed or same, by mtime_ns and file_size of the index."""
    known = index.groupBy(key).agg(F.max("mtime_ns").alias("_m"), F.max("file_size").alias("_s"))
    state = F.when(F.col("_m").isNull(), "new").when((F.col("_m") == F.col("mtime_ns")) & (F.col("_s") == F.col("file_size")), "same").otherwise("changed")
    return files.join(known, key, "left").withColumn("state", state).drop("_m", "_s")


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """new rows, the last of each key by order (ties by all columns), and old ones of other keys; where there is a column text, empty ones don't come in."""
    from .ingest import merged

    return merged(old, new, [key], [order], F.trim("text") != "" if "text" in new.columns else None)


def deleted(table: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def missing_files(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left (name, size) whose lower-cased name and size aren't in right."""
    keyed = lambda df: df.withColumn("_n", F.lower("name"))
    return keyed(left).join(keyed(right).select("_n", "size").distinct(), ["_n", "size"], "left_anti").drop("_n")


def extraction_issues(stats: DataFrame, min_blocks: int = 0, min_text_chars: int = 0, min_pages: int = 0, expect_tables: bool = False, expect_headings: bool = False) -> DataFrame:
    """stats (block_count, table_blocks, heading_blocks, text_chars, page_count) with issues and valid."""
    found = []
    for name, column, least in (("min_blocks", "block_count", min_blocks), ("min_text_chars", "text_chars", min_text_chars), ("min_pages", "page_count", min_pages)):
        if least:
            found.append(F.when(F.col(column) < least, F.concat(F.lit(f"{name}:"), F.col(column).cast("string"), F.lit(f"<{least}"))))
    if expect_tables:
        found.append(F.when(F.col("table_blocks") == 0, "expect_tables:true but no table blocks detected"))
    if expect_headings:
        found.append(F.when(F.col("heading_blocks") == 0, "expect_headings:true but no heading blocks detected"))
    issues = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")
    return stats.withColumn("issues", issues).withColumn("valid", F.size("issues") == 0)


def ranking_metrics(ranked: DataFrame, gold: DataFrame, query: str = "query_id", item: str = "item") -> DataFrame:
    """(query, recall, ndcg, mrr), rounded to 6. ranked: query, item, rank; gold: query, item, gain (one row an item).
    Queries without gold have no row; the ideal order has the greatest gains first."""
    hit = gold.join(ranked.select(query, item, "rank"), [query, item], "left")
    per = hit.groupBy(query).agg(
        F.count("*").alias("expected"), F.count("rank").alias("found"), F.coalesce(F.sum(F.col("gain") / F.log2(F.col("rank") + 1)), F.lit(0.0)).alias("dcg"), F.min("rank").alias("first")
    )
    w = Window.partitionBy(query).orderBy(F.desc("gain"), item)
    ideal = gold.withColumn("k", F.row_number().over(w)).groupBy(query).agg(F.sum(F.col("gain") / F.log2(F.col("k") + 1)).alias("idcg"))
    return per.join(ideal, query).select(
        query,
        F.round(F.col("found") / F.col("expected"), 6).alias("recall"),
        F.round(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0), 6).alias("ndcg"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
    )


def label_metrics(ranked: DataFrame, labels: DataFrame, queries: DataFrame) -> DataFrame:
    """``ranking_metrics`` where all other items of a query's label are relevant, with gain 1: labels (item, label; queries are items too).

    The relevant items of a query are counted, not listed: what a label's ideal order is worth is made once a label,
    so the work is linear in items and ranked rows."""
    sizes = labels.groupBy("label").agg((F.count("*") - 1).alias("expected")).where("expected > 0")
    ideal = sizes.select("label", F.explode(F.sequence(F.lit(1).cast("long"), F.col("expected"))).alias("k")).groupBy("label").agg(F.sum(1.0 / F.log2(F.col("k") + 1)).alias("idcg"))
    asked = queries.join(labels.withColumnRenamed("item", "query_id"), "query_id").join(sizes.join(ideal, "label"), "label")
    hits = ranked.select("query_id", "item", "rank").join(labels.select("item", F.col("label").alias("_l")), "item").join(asked.select("query_id", "label"), "query_id").where("_l = label and item <> query_id")
    found = hits.groupBy("query_id").agg(F.count("*").alias("found"), F.sum(1.0 / F.log2(F.col("rank") + 1)).alias("dcg"), F.min("rank").alias("first"))
    out = asked.join(found, "query_id", "left")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return out.select(
        "query_id", F.round(zero(F.col("found") / F.col("expected")), 6).alias("recall"), F.round(zero(F.col("dcg") / F.col("idcg")), 6).alias("ndcg"), F.round(zero(1.0 / F.col("first")), 6).alias("mrr")
    )


def sampled(rows: DataFrame, id_col: str, limit: int, seed: int = 13) -> DataFrame:
    """A seeded shuffle's first rows."""
    return rows.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(limit)


def snippet(value: Column, words: int = 12) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(value, F.lit(r"([A-Za-z0-9%°μ/+-]{2,})"), F.lit(1)), 1, words), " ")


def matched_relevance(rows: DataFrame, expectations: DataFrame) -> DataFrame:
    """(query_id, rank, expectation, gain): each row, in rank order, takes the first expectation (by number) that it matches and that no row before
    it took. rows: query_id, rank, doc_id, text; expectations: query_id, expectation, doc_id, contains, gain: a null doc_id or contains
    matches any. The match is sequential within a query, whose rows and expectations are few."""
    import pandas as pd

    pairs = rows.join(expectations.select("query_id", "expectation", "gain", F.col("doc_id").alias("_d"), F.col("contains").alias("_c")), "query_id")
    met = pairs.where((F.col("_d").isNull() | (F.col("_d") == F.col("doc_id"))) & (F.col("_c").isNull() | F.contains(F.lower("text"), F.lower("_c"))))

    def run(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        taken, out, done = set(), [], set()
        for rank, number, gain in found.sort_values(["rank", "expectation"])[["rank", "expectation", "gain"]].itertuples(index=False):
            if rank not in done and number not in taken:
                taken.add(number)
                done.add(rank)
                out.append((key[0], rank, number, gain))
        return pd.DataFrame(out, columns=["query_id", "rank", "expectation", "gain"])

    return met.select("query_id", "rank", "expectation", "gain").groupBy("query_id").applyInPandas(run, "query_id long, rank long, expectation long, gain double")


def macro_means(metrics: DataFrame, *columns: str) -> DataFrame:
    """One row: the means over queries, rounded to 6, and their number."""
    return metrics.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in columns])
