"""Registered queries of the graph build and of the ingest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import corpus, graph, graph_build, ingest, layout
from ..sources import store
from .search import query, table

# Each part is a document of one chunk: a header, a run of capitals, a measurement.
_LABEL = "upper(p_type) || ' UNIT ' || (10 + p_size)"
_TEXT = f"'The ' || {_LABEL} || ' stands here. Flow rate: ' || p_size || ' m3/h'"


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = table(spark, sf_dir, "part")
    one = lambda x: F.array(x)
    chunks = parts.select(
        F.col("p_partkey").alias("doc_id"), F.lit(0).alias("chunk_start"), F.expr(_TEXT).alias("text"), one(F.col("p_name")).alias("section_path"), one(F.lit("e1")).alias("element_ids"),
        one(F.lit("para")).alias("types"), one(F.concat(F.lit("Flow "), "p_brand")).alias("headers"),
    )
    docs = parts.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("/p/"), "p_partkey").alias("path"), one(F.col("p_name")).alias("concepts"), one(F.lit("kg")).alias("units"))
    return graph_build.built(chunks, docs)


_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_GRAPH = f"""p AS (SELECT p_partkey AS k, p_name AS name, p_size AS size, 'Flow ' || p_brand AS header, {_LABEL} AS label, 'doc::' || p_partkey AS doc, 'chunk::' || p_partkey || '::e1' AS chunk,
  'section::' || p_partkey || '::' || substr(sha256('["' || p_name || '"]'), 1, 16) AS section FROM part),
m AS (SELECT *, 'measurement::' || substr(sha256('Flow rate|' || size || '|m3/h|' || k || '|' || chunk), 1, 16) AS measure FROM p),
n AS (SELECT doc AS id, '/p/' || k AS label, 'doc' AS type, k, 0 AS seq FROM m UNION ALL SELECT 'entity::' || {_SLUG.format("name")}, name, 'concept', k, 1 FROM m WHERE length(name) >= 4
  UNION ALL SELECT 'entity::kg', 'kg', 'unit', k, 1 FROM m UNION ALL SELECT section, name, 'section', k, 2 FROM m UNION ALL SELECT chunk, 'e1', 'para', k, 3 FROM m UNION ALL SELECT 'entity::flow-rate', 'Flow rate', 'parameter', k, 3 FROM m
  UNION ALL SELECT 'entity::' || {_SLUG.format("header")}, header, 'entity', k, 4 FROM m UNION ALL SELECT 'entity::' || {_SLUG.format("label")}, label, 'entity', k, 4 FROM m UNION ALL SELECT measure, size || ' m3/h', 'measurement', k, 5 FROM m),
nodes AS (SELECT id, arg_max(label, (seq, k, label, type)) AS label, arg_max(type, (seq, k, label, type)) AS type, count(DISTINCT k) AS docs FROM n GROUP BY id),
e AS (SELECT doc AS src, 'entity::' || {_SLUG.format("name")} AS dst, 'has_concept' AS type, k FROM m WHERE length(name) >= 4 UNION ALL SELECT doc, 'entity::kg', 'uses_unit', k FROM m UNION ALL SELECT doc, section, 'has_section', k FROM m
  UNION ALL SELECT section, chunk, 'contains', k FROM m UNION ALL SELECT chunk, 'entity::' || {_SLUG.format("header")}, 'row_has_parameter', k FROM m UNION ALL SELECT chunk, 'entity::' || {_SLUG.format("label")}, 'mentions', k FROM m
  UNION ALL SELECT chunk, measure, 'mentions', k FROM m UNION ALL SELECT 'entity::flow-rate', measure, 'has_measurement', k FROM m UNION ALL SELECT chunk, 'entity::flow-rate', 'mentions', k FROM m),
edges AS (SELECT src, dst, type, min(k) AS doc_id FROM e GROUP BY ALL)"""


@query(f"WITH {_GRAPH} SELECT id, label, type, docs FROM nodes")
def build_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[0].select("id", "label", "type", F.size("doc_ids").cast("long").alias("docs"))


@query(f"WITH {_GRAPH} SELECT * FROM edges")
def build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[1]


@query(f"WITH {_GRAPH} SELECT v.id AS measurement, v.label, c.src AS chunk, n.label AS parameter FROM nodes v JOIN edges c ON c.dst = v.id AND c.type = 'mentions' JOIN edges h ON h.dst = v.id AND h.type = 'has_measurement' JOIN nodes n ON n.id = h.src WHERE v.type = 'measurement'")
def measurement_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_build.measurement_rows(*_graph(spark, sf_dir))


@query(
    f"""WITH {_GRAPH}, mm AS (SELECT DISTINCT src AS chunk, dst AS entity FROM edges WHERE type IN ('mentions', 'row_has_parameter') AND dst LIKE 'entity::%')
SELECT a.entity AS "left", b.entity AS "right", count(*) AS n FROM mm a JOIN mm b ON a.chunk = b.chunk AND a.entity < b.entity GROUP BY ALL"""
)
def co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _graph(spark, sf_dir)[1].where("type in ('mentions', 'row_has_parameter') and dst like 'entity::%'")
    return graph_build.co_occurrences(edges.select(F.col("src").alias("chunk"), F.col("dst").alias("entity")))


@query(f"WITH {_GRAPH} SELECT type, count(*) AS n FROM edges GROUP BY ALL")
def edge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[1].groupBy("type").agg(F.count("*").alias("n"))


@query(None)
def graph_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that the prune pipeline leaves of the parts' graph; tests hold it against brute force."""
    nodes, edges = _graph(spark, sf_dir)
    # without doc_ids, no node's documents are gathered: some nodes are in every document
    nodes, edges = (store.written(x, "graph") for x in (nodes.select("id", "label", "type"), edges))
    return graph.pruned(nodes, edges)[0]


@query(None)
def keyphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks; a stand-in for a ranker, held against brute force in tests."""
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("chunk_start"), "text")
    return graph_build.keyphrases(chunks, bounds=graph_build.phrase_bounds(chunks))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def hash_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that lacks every third document and has other hashes for every fifth: those are to be ingested."""
    docs = _docs(spark, sf_dir)
    index = docs.where("doc_id % 3 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("content_hash")))
    return ingest.unseen(docs, index).select("doc_id")


@query("SELECT doc_id, md5(trim(text)) AS text_md5 FROM documents WHERE trim(text) <> '' AND len(regexp_extract_all(trim(text), '[A-Za-z]{2,}')) >= 30")
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.backfilled(_docs(spark, sf_dir), 30).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query("SELECT doc_id, source FROM documents WHERE NOT (lang = 'en' AND source = 'src1')")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.deleted_where(table(spark, sf_dir, "documents"), lang="en", source="src1").select("doc_id", "source")


@query("SELECT o_custkey AS doc_id, arg_max(o_orderkey, (o_orderkey, o_orderkey % 100)) AS mtime_ns, arg_max(o_orderkey % 100, (o_orderkey, o_orderkey % 100)) AS file_size FROM orders GROUP BY ALL")
def index_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a customer's index rows."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("mtime_ns"), (F.col("o_orderkey") % 100).alias("file_size"), F.lit("h").alias("content_hash"))
    return ingest.index_metadata(rows).select("doc_id", "mtime_ns", "file_size")


@query("SELECT vec_id, len(embedding)::INTEGER AS size FROM embeddings WHERE vec_id % 4 <> 0")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with checked vectors; every fourth vector is null and its chunk left out whole."""
    vectors = table(spark, sf_dir, "embeddings")
    size = len(vectors.first()["embedding"]) if not vectors.isEmpty() else 1
    checked = ingest.checked_vectors(vectors, size, "cosine")
    some = checked.select(F.col("vec_id").alias("chunk_id"), F.when(F.col("vec_id") % 4 != 0, F.col("embedding")).alias("embedding"))
    return ingest.embedded(vectors.select(F.col("vec_id").alias("chunk_id"), "label"), some).select(F.col("chunk_id").alias("vec_id"), F.size("embedding").alias("size"))


@query("""SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"profile":"heading_based","size":' || n_chars || '}') AS plan_hash FROM documents""")
def plan_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = layout.plan_hash(size=F.col("n_chars"), doc_id=F.col("doc_id"), profile=F.lit("heading_based"), plan_hash=F.lit("before"))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("plan_hash"))


@query(
    """WITH m AS (SELECT doc_id, octet_length(encode('{"summary":' || to_json(substr(text, 1, 320))::VARCHAR || ',"n":' || n_chars || '}')) AS size FROM documents)
SELECT doc_id, CASE WHEN doc_id % 10 >= 8 THEN 'metadata_budget_exceeded' WHEN size > 300 THEN 'metadata_bytes_exceeded:' || size || '>300' END AS verdict FROM m"""
)
def metadata_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.struct(F.substring("text", 1, 320).alias("summary"), F.col("n_chars").alias("n"))
    return table(spark, sf_dir, "documents").select("doc_id", layout.metadata_verdict(meta, (F.col("doc_id") % 10).cast("int") - 6, 300).alias("verdict"))


_WIN = """c AS (SELECT doc_id, i AS chunk_start, substr(text, (i + 1)::BIGINT, 900) AS text FROM (SELECT doc_id, text, length(text) AS n, unnest(range(0, length(text), 750)) AS i FROM documents WHERE length(text) > 0)
  WHERE (i = 0 OR i - 750 + 900 < n) AND trim(regexp_replace(substr(text, (i + 1)::BIGINT, 900), '\\s+', ' ', 'g')) <> '')"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import chunking

    return chunking.windows(table(spark, sf_dir, "documents"), size=900, overlap=150)


@query(f"WITH {_WIN} SELECT doc_id, k::INTEGER AS index, length(text)::INTEGER AS length, substr(text, 1, 280) AS preview FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_start) - 1 AS k FROM c) WHERE k < 8")
def chunk_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.previews(_windows(spark, sf_dir))


@query("WITH u AS (SELECT o_custkey AS doc_id, o_orderpriority AS unit, min(o_orderkey) AS since FROM orders GROUP BY ALL) SELECT doc_id, array_to_string((list(unit ORDER BY since))[1:3], ';') AS units FROM u GROUP BY doc_id")
def collected_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities of a customer's orders as units, in the order of their coming."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("chunk_start"), F.array("o_orderpriority", F.lit(" ")).alias("units"))
    return layout.collected_units(rows, limit=3).select("doc_id", F.array_join("units", ";").alias("units"))


@query(
    """WITH r AS (SELECT l_orderkey AS chunk_id, 't' || l_suppkey AS target FROM lineitem WHERE l_quantity > 45)
SELECT o_orderkey AS chunk_id, coalesce(string_agg(DISTINCT target, ',' ORDER BY target), '') AS crossrefs FROM orders LEFT JOIN r ON chunk_id = o_orderkey GROUP BY o_orderkey"""
)
def link_crossrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("chunk_id"), F.concat(F.lit("t"), "l_suppkey").alias("target"))
    return ingest.with_crossrefs(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id")), refs).select("chunk_id", F.array_join("crossrefs", ",").alias("crossrefs"))


@query("SELECT p_partkey AS doc_id, CASE WHEN p_size % 2 = 0 AND p_partkey % 3 <> 2 THEN p_partkey + 100 ELSE 1 END AS page, 1 AS pages FROM part")
def fix_table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    element = lambda i: F.concat(F.lit(f"e{i}_"), F.col("p_partkey"))
    chunks = parts.select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("chunk_start"), F.array(element(1), element(2)).alias("element_ids"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("table_row"), F.lit("para"))).otherwise(F.array(F.lit("para"))).alias("types"), F.array(F.lit(1).cast("long")).alias("pages"))
    fixes = parts.where("p_partkey % 3 = 0").select(element(1).alias("element_id"), (F.col("p_partkey") + 7).alias("page")).unionByName(parts.where("p_partkey % 3 <> 2").select(element(2).alias("element_id"), (F.col("p_partkey") + 100).alias("page")))
    return ingest.with_table_pages(chunks, fixes).select("doc_id", F.col("pages")[0].alias("page"), F.size("pages").alias("pages"))


@query("SELECT doc_id, concat_ws(';', 'own=x', CASE WHEN doc_id >= 0 THEN 'DAF=dissolved air flotation,float' END) AS synonyms FROM documents")
def add_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.array(F.struct(F.lit("own").alias("term"), F.array(F.lit("x")).alias("replacements")))
    rows = ingest.with_synonyms(table(spark, sf_dir, "documents").select("doc_id", own.alias("synonyms")), {"DAF": ["dissolved air flotation", "float"], "own": ["x"], "": ["y"]})
    said = F.transform("synonyms", lambda s: F.concat(s["term"], F.lit("="), F.array_join(s["replacements"], ",")))
    return rows.select("doc_id", F.array_join(said, ";").alias("synonyms"))


@query(None)
def ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's chunks of all documents; tests hold the fold against brute force."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/"), "source").alias("path"), "text")
    out = ingest.ingested(docs)["chunks"]
    return out.select("doc_id", "chunk", "chunk_id", "chunk_start", "chunk_end", "profile", F.array_join("types", ",").alias("types"), F.array_join("element_ids", ",").alias("element_ids"))


@query("SELECT count(*) AS queries, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM labels")
def macro_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.macro_means(table(spark, sf_dir, "labels"), "quality", "toxic")


@query(
    """WITH m AS (SELECT avg(quality) AS quality, avg(toxic) AS toxic, avg(NULL::DOUBLE) AS latency FROM labels)
SELECT metric, round(value, 6) AS value, threshold FROM (SELECT 'quality' AS metric, quality AS value, 0.99::DOUBLE AS threshold, quality < 0.99 AS bad FROM m UNION ALL SELECT 'toxic', toxic, 0.01, toxic > 0.01 FROM m UNION ALL SELECT 'latency', latency, 3000.0, true FROM m) WHERE bad"""
)
def threshold_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "labels").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"), F.lit(None).cast("double").alias("latency"))
    return ingest.breaches(means, {"quality": 0.99}, {"toxic": 0.01, "latency": 3000.0}).select("metric", F.round("value", 6).alias("value"), "threshold")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'not json ' || event_type ELSE replace(props, ' ', '') END AS value FROM events")
def json_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("not json "), "event_type")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", text.json_or_raw(raw).alias("value"))


@query("""SELECT p_partkey, p_name || '|' || p_type AS parts FROM part WHERE p_partkey % 4 <> 2 UNION ALL SELECT p_partkey, '' FROM part WHERE p_partkey % 4 = 2""")
def section_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.to_json(F.array("p_name", F.lit(""), "p_type"))).when(k == 1, F.concat("p_name", F.lit(" > "), "p_type")).when(k == 3, F.concat(F.lit(">"), "p_name", F.lit(">  > "), "p_type", F.lit(" ")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.section_parts(raw), "|").alias("parts"))


@query(
    """WITH s AS (SELECT doc_id, source, lang, substr(array_to_string(regexp_extract_all(text, '[A-Za-z0-9%°μ/+-]{2,}')[1:12], ' '), 1, 120) AS q FROM documents)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Which passage in "' || source || ' > ' || lang || '" discusses "' || q || '" in ' || source || '?' ELSE 'Where in ' || source || ' is the phrase "' || q || '" explained?' END AS question FROM s"""
)
def gold_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.when(F.col("doc_id") % 2 == 0, F.array("source", "lang")).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("doc_id", text.gold_question(corpus.snippet(F.col("text")), section, F.col("source")).alias("question"))


@query("SELECT doc_id, md5(substr(text, 1, 900)) AS rerank_md5, md5(substr(text, 1, 500)) AS embed_md5 FROM documents")
def model_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda x: F.md5(F.encode(x, "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", digest(text.reranker_window(F.col("text"))).alias("rerank_md5"), digest(text.embed_window(F.col("text"))).alias("embed_md5"))


@query("SELECT p_partkey, substr(sha256(p_name || '|' || p_size || '|cm|' || p_partkey || '|c1'), 1, 16) AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS term FROM part")
def ids_and_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurement ids, and subword terms cleaned: numbers alone are none."""
    made = text.measurement_id(F.col("p_name"), F.col("p_size"), F.lit("cm"), F.col("p_partkey"), F.lit("c1"))
    term = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("##-"), F.upper("p_name"), F.lit("'"))).otherwise(F.lit("##1234"))
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("id"), text.clean_sparse_term(term).alias("term"))


@query("SELECT url AS path, CASE WHEN url LIKE 'https://%' THEN replace('W:/' || substr(url, 9), '/', chr(92)) ELSE url END AS shown FROM pages")
def path_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import translated_path

    return table(spark, sf_dir, "pages").select(F.col("url").alias("path"), translated_path(F.col("url"), "https://", "W:/").alias("shown"))


@query(None)
def plain_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' texts in chunks with a character overlap; a test holds the fold."""
    out = layout.text_chunks(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "chunk", "start", "end", "kind", F.length("text").alias("chars"))
