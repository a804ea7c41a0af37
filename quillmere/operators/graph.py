"""Knowledge graph: entities, relations, measurements, lookups and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources import store

#: Patterns of entities, measurements, relations and junk labels.
UPPER_ENTITY = r"\b([A-Z]{3,}(?:\s+[A-Z0-9]{2,})*)\b"
MEASUREMENT = r"([A-Za-z][A-Za-z0-9\s/%°\-\(\)]{2,}?)\s*(?:=|:)\s*(-?\d+(?:\.\d+)?(?:\s*[x×]\s*10\^\d+)?)\s*([A-Za-zμ/%°\-\^0-9]+)?"
RELATIONS = {
    "feeds": r"(?i)([A-Za-z][\w\s/\-\(\)]{2,}?)\s+(?:feeds|supplies|pumps|returns|sends)\s+([A-Za-z][\w\s/\-\(\)]{2,})",
    "discharges_to": r"(?i)([A-Za-z][\w\s/\-\(\)]{2,}?)\s+(?:discharges|drains|flows)\s+(?:to|into)\s+([A-Za-z][\w\s/\-\(\)]{2,})",
    "located_in": r"(?i)([A-Za-z][\w\s/\-\(\)]{2,}?)\s+(?:located|installed|situated)\s+(?:in|at|inside)\s+([A-Za-z][\w\s/\-\(\)]{2,})",
}
#: The verbs of RELATIONS between white space: a text without one has no relation, and this is found in one pass.
VERBS = r"(?i)\s(?:feeds|supplies|pumps|returns|sends|discharges|drains|flows|located|installed|situated)\s"
JUNK = [
    r"^isbn[:\s-]*\d",
    r"^\d{3,}$",
    r"^doi:",
    r"^copyright\s+\d{4}",
    r"^all rights reserved",
    r"^printed in",
    r"^published by",
    r"remains neutral",
    r"including drinking",
    r"^page \d+$",
    r"^chapter \d+$",
    r"^section \d+",
    r"^figure \d+",
    r"^table \d+",
    r"^appendix [a-z]$",
]


def upper_entities(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label): runs of capitals of four characters or more, once a chunk by their lower-case form."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(UPPER_ENTITY), F.lit(1))
    out = chunks.select(id_col, F.posexplode(found).alias("pos", "label")).where(F.length("label") >= 4)
    w = Window.partitionBy(id_col, F.lower("label")).orderBy("pos")
    return out.withColumn("n", F.row_number().over(w)).where("n = 1").select(id_col, "label")


def relations(chunks: DataFrame, entities: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, src, type, dst) of the verb patterns whose two sides are both known entities (id, label) of the chunk, normalised."""
    out, chunks = None, chunks.where(F.col(text_col).rlike(VERBS))
    for kind, pattern in RELATIONS.items():
        sides = [F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(i)) for i in (1, 2)]
        some = chunks.select(id_col, F.explode(F.arrays_zip(sides[0].alias("a"), sides[1].alias("b"))).alias("x"), F.lit(kind).alias("type"))
        some = some.select(id_col, text.normalise_label(F.col("x.a")).alias("src"), "type", text.normalise_label(F.col("x.b")).alias("dst"))
        out = some if out is None else out.unionByName(some)
    known = entities.select(id_col, text.normalise_label(F.col("label")).alias("src")).distinct()
    return out.join(known, [id_col, "src"], "left_semi").join(known.withColumnRenamed("src", "dst"), [id_col, "dst"], "left_semi").select(id_col, "src", "type", "dst").distinct()


def measurements(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 20) -> DataFrame:
    """(id, parameter, value, unit): the first of each (parameter, unit), at most limit a chunk."""
    parts = [F.regexp_extract_all(F.col(text_col), F.lit(MEASUREMENT), F.lit(i)) for i in (1, 2, 3)]
    out = chunks.select(id_col, F.posexplode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "pvu", strict=True)])).alias("pos", "x"))
    out = out.select(id_col, "pos", F.trim("x.p").alias("parameter"), F.trim("x.v").alias("value"), F.nullif("x.u", F.lit("")).alias("unit")).where(F.length("parameter") >= 4)
    first = Window.partitionBy(id_col, F.lower("parameter"), F.lower(F.coalesce("unit", F.lit("")))).orderBy("pos")
    out = out.withColumn("k", F.row_number().over(first)).where("k = 1")
    return out.withColumn("k", F.row_number().over(Window.partitionBy(id_col).orderBy("pos"))).where(F.col("k") <= limit).drop("k", "pos")


def neighbours(nodes: DataFrame, edges: DataFrame, node_id, limit: int) -> DataFrame:
    """(direction, type, id, label) of a node's edges either way, by type and id, at most limit each way."""
    halves = []
    for direction, here, there in (("out", "src", "dst"), ("in", "dst", "src")):
        some = edges.where(F.col(here) == node_id).select("type", F.col(there).alias("id")).join(nodes.select("id", "label"), "id")
        halves.append(some.orderBy("type", "id").limit(limit).select(F.lit(direction).alias("direction"), "type", "id", "label"))
    return halves[0].unionByName(halves[1])


def merged_nodes(rows: DataFrame) -> DataFrame:
    """(id, label, type, doc_ids) from (id, label, type, doc_id, seq): the last writer's label and type, all documents."""
    return rows.groupBy("id").agg(F.max_by("label", "seq").alias("label"), F.max_by("type", "seq").alias("type"), F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))


def junk(label: Column) -> Column:
    low = F.lower(F.trim(label))
    out = F.length(low) < 2
    for pattern in JUNK:
        out = out | low.rlike(pattern)
    n = F.greatest(F.length(low), F.lit(1))
    return out | (F.regexp_count(low, F.lit("[0-9]")) / n > 0.9) | (F.regexp_count(low, F.lit(r"\p{L}")) / n < 0.4)


def tf_idf(mentions: DataFrame, entity: str = "entity", doc: str = "doc_id") -> DataFrame:
    """(entity, df, total, max_tf, mean_tf, tfidf), rounded to 6; idf = ln((D + 1) / (df + 1)) over the D documents with mentions."""
    per = mentions.groupBy(entity, doc).agg(F.count("*").alias("tf"))
    out = per.groupBy(entity).agg(F.count("*").alias("df"), F.sum("tf").alias("total"), F.max("tf").alias("max_tf"), F.avg("tf").alias("mean_tf"))
    idf = F.log((F.col("n_docs") + 1) / (F.col("df") + 1))
    out = out.crossJoin(F.broadcast(mentions.agg(F.countDistinct(doc).alias("n_docs"))))
    score = 0.7 * F.log1p("max_tf") * idf + 0.3 * F.log1p("mean_tf") * idf
    return out.select(entity, "df", "total", "max_tf", F.round("mean_tf", 6).alias("mean_tf"), F.round(score, 6).alias("tfidf"))


def bucketed(scored: DataFrame, percent: int, entity: str = "entity") -> DataFrame:
    """scored with df_bucket (1, 2-5, 6+), rank in it by tfidf (ties by the entity) and kept: the best int(n * percent / 100) of each.

    Three buckets hold all entities, so no window takes a bucket whole: rows are range-partitioned in the order of their ranks, and
    a row's rank is its place in its own range, plus the rows of the bucket in the ranges before. Ties fall into ranges like any other rows."""
    bucket = F.when(F.col("df") == 1, "1").when(F.col("df") <= 5, "2-5").otherwise("6+")
    order = [F.col("df_bucket"), F.desc("tfidf"), F.col(entity)]
    rows = store.written(scored.withColumn("df_bucket", bucket).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = rows.groupBy("df_bucket", "_range").agg(F.count("*").alias("here"))  # a row a range and bucket
    before = Window.partitionBy("df_bucket").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_before": F.coalesce(F.sum("here").over(before), F.lit(0)), "_n": F.sum("here").over(Window.partitionBy("df_bucket"))}).drop("here")
    rank = F.row_number().over(Window.partitionBy("df_bucket", "_range").orderBy(F.desc("tfidf"), entity)) + F.col("_before")
    rows = rows.join(F.broadcast(counts), ["df_bucket", "_range"]).withColumn("bucket_rank", rank)
    return rows.withColumn("kept", F.col("bucket_rank") <= F.floor(F.col("_n") * percent / 100)).drop("_range", "_before", "_n")


def pruned(nodes: DataFrame, edges: DataFrame, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after: co_occurs edges go, equal edges once, junk and low-scored entities go unless a
    measurement or table row names them, then mentions of what went, then nodes without edges (documents stay)."""
    edges = edges.where("type <> 'co_occurs'").dropDuplicates(["src", "dst", "type"])
    protected = edges.where(F.col("type").isin("has_measurement", "measures", "row_has_parameter")).select(F.col("dst").alias("id")).distinct()
    mentions = edges.where("type = 'mentions'").select(F.col("dst").alias("entity"), F.col("doc_id"))
    kept = bucketed(tf_idf(mentions), percent).where("kept").select(F.col("entity").alias("id"))
    entities = nodes.where("type = 'entity'")
    good = entities.where(~junk(F.col("label"))).join(kept, "id", "left_semi").select("id").union(entities.join(protected, "id", "left_semi").select("id")).distinct()
    lost = entities.join(good, "id", "left_anti").select("id")
    edges = edges.join(lost.withColumnRenamed("id", "src"), "src", "left_anti").join(lost.withColumnRenamed("id", "dst"), "dst", "left_anti")
    used = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    rest = nodes.join(lost, "id", "left_anti")
    return rest.where("type = 'doc'").unionByName(rest.where("type <> 'doc'").join(used, "id", "left_semi")), edges
