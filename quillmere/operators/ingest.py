"""The ingest chain as tables in, tables out: guards, merges, enhancement, payloads, administration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from . import chunking, corpus, graph_build, layout

#: Why a table is no collection of vectors of one size and metric.
METRICS = ("cosine", "dot", "euclid")


def checked_vectors(rows: DataFrame, size: int, metric: str, known: dict | None = None, vector_col: str = "embedding") -> DataFrame:
    """rows, of which reading one with a vector of another size raises an error; null vectors pass. known (size, metric)
    of a collection that exists already must be the same."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if known and (known["size"], known["metric"]) != (size, metric):
        raise ValueError(f"the collection has size {known['size']} and metric {known['metric']}, not {size} and {metric}")
    said = F.concat(F.lit(f"vector of another size than {size}: "), F.size(vector_col).cast("string"))
    return rows.withColumn(vector_col, F.when(F.col(vector_col).isNull() | (F.size(vector_col) == size), F.col(vector_col)).otherwise(F.raise_error(said)))


def merged(old: DataFrame, new: DataFrame, keys: list[str], order: list[str], where: Column | None = None) -> DataFrame:
    """new rows, the last of each key by order (descending; all columns decide ties), and old ones of other keys. where: what new rows must meet."""
    new = new if where is None else new.where(where)
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order], *[F.desc(c) for c in sorted(new.columns) if c not in keys and c not in order])
    latest = new.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return old.join(latest.select(*keys), keys, "left_anti").unionByName(latest, allowMissingColumns=True)


def deleted_where(table: DataFrame, **equal) -> DataFrame:
    """table without the rows that equal all the given values; a null value never matches, as in a filter by payload."""
    hit = F.lit(bool(equal))
    for name, value in equal.items():
        hit = hit & (F.col(name) == F.lit(value))
    return table.where(~F.coalesce(hit, F.lit(False)))


def known_rows(rows: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys the index holds; a set-wise existence probe."""
    return rows.join(index.select(*keys).distinct(), keys, "left_semi")


def unseen(docs: DataFrame, index: DataFrame, id_col: str = "doc_id", hash_col: str = "content_hash") -> DataFrame:
    """docs whose (id, content hash) the index doesn't hold: new documents and changed ones."""
    return docs.join(index.select(id_col, hash_col).distinct(), [id_col, hash_col], "left_anti")


def index_metadata(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, mtime_ns, file_size, content_hash) of a document's row with the greatest mtime_ns; one row a document."""
    last = F.max(F.struct("mtime_ns", "file_size", "content_hash"))
    return index.groupBy(id_col).agg(last.alias("x")).select(id_col, "x.mtime_ns", "x.file_size", "x.content_hash")


def backfilled(payloads: DataFrame, min_words: int = 0, text_col: str = "text") -> DataFrame:
    """Rows of vector payloads for the lexical index: trimmed texts, those that are empty or have fewer words left out."""
    out = payloads.withColumn(text_col, F.trim(text_col)).where(F.col(text_col) != "")
    return out.where(text.word_count(F.col(text_col)) >= min_words) if min_words else out


def thin(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Payloads without their text, which ``routes.hydrated`` brings back."""
    return rows.drop(text_col)


def embedded(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """chunks with their vectors (key, embedding), by key; those whose vector is missing or null are left out whole."""
    return chunks.join(vectors.where("embedding is not null").select(key, "embedding"), key)


def with_synonyms(chunks: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """chunks with synonyms array<struct<term, replacements>>: those there are and the given ones, each once."""
    kind = "array<struct<term:string,replacements:array<string>>>"
    given = F.array(*[F.struct(F.lit(t).alias("term"), F.array(*map(F.lit, r)).alias("replacements")) for t, r in synonyms.items() if t and r])
    had = F.coalesce(F.col("synonyms"), F.array().cast(kind)) if "synonyms" in chunks.columns else F.array().cast(kind)
    return chunks.withColumn("synonyms", F.array_distinct(F.concat(had, given.cast(kind))))


def with_crossrefs(chunks: DataFrame, references: DataFrame, key: str = "chunk_id") -> DataFrame:
    """chunks with crossrefs: the targets of references (key, target), each once, those there are first."""
    links = references.where(f"{key} is not null and target is not null").groupBy(key).agg(F.array_sort(F.collect_set("target")).alias("_t"))
    none = F.array().cast("array<string>")
    had = F.coalesce(F.col("crossrefs"), none) if "crossrefs" in chunks.columns else none
    return chunks.join(links, key, "left").withColumn("crossrefs", F.array_union(had, F.coalesce("_t", none))).drop("_t")


def with_table_pages(chunks: DataFrame, fixes: DataFrame) -> DataFrame:
    """chunks (element_ids, types, pages) that hold a table row, with the page that fixes (element_id, page) give their last element that has one."""
    each = chunks.select("doc_id", "chunk_start", F.posexplode("element_ids").alias("pos", "element_id")).join(fixes.select("element_id", "page"), "element_id")
    last = each.groupBy("doc_id", "chunk_start").agg(F.max(F.struct("pos", "page")).alias("_x"))
    fixed = F.when(F.array_contains("types", "table_row") & F.col("_x").isNotNull(), F.array("_x.page")).otherwise(F.col("pages"))
    return chunks.join(last, ["doc_id", "chunk_start"], "left").withColumn("pages", fixed).drop("_x")


def chunk_ids(chunks: DataFrame, id_col: str = "doc_id", namespace: str = "6ba7b811-9dad-11d1-80b4-00c04fd430c8", scheme: str = "doc://") -> DataFrame:
    """chunks with chunk_id: uuid5 of the document's uuid5 and "start-end"."""
    doc = text.uuid5(F.lit(namespace), F.concat(F.lit(scheme), F.col(id_col).cast("string")))
    span = F.concat_ws("-", F.col("chunk_start").cast("string"), F.col("chunk_end").cast("string"))
    return chunks.withColumn("_d", doc).withColumn("chunk_id", text.uuid5(F.col("_d"), span)).drop("_d")


def ingested(docs: DataFrame, index: DataFrame | None = None, max_chars: int = 900, min_words: int = 0) -> dict[str, DataFrame]:
    """The whole chain over a table of plain texts (doc_id, path, text) as one plan for each output: blocks, chunks, metadata,
    summaries, nodes, edges. index (doc_id, content_hash): documents of the same hash there are skipped.

    Nothing runs until an output is read; write what several need. Documents with fewer than min_words words are left out."""
    docs = docs.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    if index is not None:
        docs = unseen(docs, index)
    if min_words > 0:
        docs = docs.where(F.coalesce(text.word_count(F.col("text")), F.lit(0)) >= min_words)
    found = chunking.blocks(docs)
    blocks = found.select("doc_id", "block", "kind", F.array_join("lines", "\n").alias("text"), "level", "start")
    blocks = layout.with_paths(blocks, level=F.col("level")).withColumn("element_id", layout.element_ids(F.col("kind"), F.lit(1), F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("block"))))
    chunks = chunk_ids(chunking.text_folds(docs, max_chars))
    concepts = corpus.concepts(docs)
    units = layout.collected_units(chunks)
    meta = docs.select("doc_id", "path", "text").join(concepts, "doc_id", "left").join(units, "doc_id", "left")
    none = F.array().cast("array<string>")
    meta = meta.select(
        "doc_id", "path", corpus.summary(F.col("text")).alias("summary"), F.coalesce("concepts", none).alias("concepts"), F.coalesce("units", none).alias("units"),
        corpus.quality_score(F.trim("text") != "", F.size(F.coalesce("concepts", none))).alias("quality_score"),
    )
    nodes, edges = graph_build.built(chunks, meta)
    summaries = corpus.section_summaries(chunks, ["doc_id", "section_path"], "chunk_start")
    return {"blocks": blocks, "chunks": chunks, "metadata": meta, "summaries": summaries, "nodes": nodes, "edges": edges}


def breaches(metrics: DataFrame, least: dict[str, float] | None = None, most: dict[str, float] | None = None) -> DataFrame:
    """(metric, value, threshold) of the columns of a one-row table of metrics that are under least or over most; a null breaches."""
    checks = [(n, t, F.coalesce(F.col(n) < t, F.lit(True))) for n, t in (least or {}).items()] + [(n, t, F.coalesce(F.col(n) > t, F.lit(True))) for n, t in (most or {}).items()]
    if not checks:
        return metrics.select(F.lit("").alias("metric"), F.lit(0.0).alias("value"), F.lit(0.0).alias("threshold")).where("false")
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"), F.lit(float(t)).alias("threshold"), bad.alias("bad")) for n, t, bad in checks])
    return metrics.select(F.inline(rows)).where("bad").drop("bad")


def swapped(spark: SparkSession, alias: str, table: DataFrame) -> None:
    """Points a view's name at another table in one step; readers see the one before or after."""
    table.createOrReplaceTempView(alias)


def collections(spark: SparkSession, pattern: str | None = None) -> list[tuple[str, bool]]:
    """(name, is temporary) of the catalog's tables and views, by name; those that match a pattern where one is given."""
    import re

    found = sorted((t.name, t.isTemporary) for t in spark.catalog.listTables())
    return [x for x in found if pattern is None or re.search(pattern, x[0])]


def dropped_collections(spark: SparkSession, pattern: str) -> list[str]:
    """Drops the tables and views whose names match a pattern, and names them."""
    gone = collections(spark, pattern)
    for name, temporary in gone:
        if temporary:
            spark.catalog.dropTempView(name)
        else:
            spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    return [name for name, _ in gone]


def folder_sizes(spark: SparkSession, root: str) -> DataFrame:
    """(name, bytes, files) of the folders right under root, by Hadoop's own summary."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for x in fs.listStatus(at) if fs.exists(at) else []:
        summary = fs.getContentSummary(x.getPath())
        rows.append((x.getPath().getName(), summary.getLength(), summary.getFileCount()))
    return spark.createDataFrame(sorted(rows), "name string, bytes long, files long")
