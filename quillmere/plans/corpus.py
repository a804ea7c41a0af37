"""Registered corpus queries (chunks, lookups, metadata, graph, maintenance) and their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking, corpus, graph, ingest, lookup
from .search import _BM25, _ITEM_TERMS, _of_items, query, table

_CHUNKS = """c AS (SELECT doc_id, i AS chunk_start, least(i + 900, n) AS chunk_end, substr(text, (i + 1)::BIGINT, 900) AS text FROM (
  SELECT doc_id, text, length(text) AS n, unnest(range(0, length(text), 750)) AS i FROM documents WHERE length(text) > 0)
  WHERE (i = 0 OR i - 750 + 900 < n) AND trim(regexp_replace(substr(text, (i + 1)::BIGINT, 900), '\\s+', ' ', 'g')) <> '')"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.windows(table(spark, sf_dir, "documents"), size=900, overlap=150)


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk_start, chunk_end, md5(text) AS text_md5 FROM c")
def fixed_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", "chunk_start", "chunk_end", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


_NS = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def _uuid5(namespace: str, name: str) -> str:
    h = f"sha1(unhex(replace({namespace}, '-', '')) || encode({name}))"
    v = f"(['8', '9', 'a', 'b'])[(instr('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1]"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {v} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


_DOC_UUID, _CHUNK_UUID = _uuid5(f"'{_NS}'", "'doc://' || doc_id"), _uuid5("u", "chunk_start || '-' || chunk_end")


@query(f"WITH {_CHUNKS}, d AS (SELECT *, {_DOC_UUID} AS u FROM c) SELECT doc_id, chunk_start, {_CHUNK_UUID} AS chunk_id FROM d")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.chunk_ids(_chunks(spark, sf_dir)).select("doc_id", "chunk_start", "chunk_id")


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL) SELECT doc_id, pos, md5(x[pos + 1]) AS line_md5, (coalesce(list_sum(list_transform(x[1:pos], lambda y: length(y) + 1)), 0))::BIGINT AS start FROM (SELECT doc_id, x, unnest(range(0, len(x)))::INTEGER AS pos FROM l)")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.lines(table(spark, sf_dir, "documents")).select("doc_id", "pos", F.md5(F.encode("line", "UTF-8")).alias("line_md5"), "start")


@query(None)
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.html_blocks(table(spark, sf_dir, "pages"))


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.html_blocks(table(spark, sf_dir, "pages")).withColumnRenamed("page_id", "doc_id")


@query(None)
def structured_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _paged(spark, sf_dir).withColumn("section_path", F.array().cast("array<string>"))
    return chunking.structured_chunks(out).select("doc_id", "chunk", "text", F.array_join("types", ",").alias("types"), "chunk_start", "chunk_end", F.col("profile"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]{2,}'))::INTEGER AS words FROM documents WHERE len(regexp_extract_all(text, '[A-Za-z]{2,}')) >= 20")
def min_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("words")).where("words >= 20")


@query(
    f"""WITH {_CHUNKS}, n AS (SELECT doc_id, chunk_start, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_start) AS no FROM c),
a AS (SELECT doc_id, chunk_start AS anchor_start, no FROM n)
SELECT a.doc_id, anchor_start, n.chunk_start FROM a JOIN n ON n.doc_id = a.doc_id AND n.no BETWEEN a.no - 2 AND a.no + 2"""
)
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two chunks before and after each chunk."""
    return lookup.near_all(_chunks(spark, sf_dir), 2)


@query(
    f"""WITH {_CHUNKS} SELECT doc_id, chunk_start, md5(string_agg(text, chr(10)) OVER w) AS context_md5, min(chunk_start) OVER w AS context_start, max(chunk_end) OVER w AS context_end
FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_start ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"""
)
def neighbor_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lookup.context(_chunks(spark, sf_dir))
    return out.select("doc_id", "chunk_start", F.md5(F.encode("context_text", "UTF-8")).alias("context_md5"), "context_start", "context_end")


@query("SELECT doc_id, substr(text, 11, 40) AS part FROM documents")
def open_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", lookup.text_slice(F.col("text"), 10, 50).alias("part"))


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'of')")
def where_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(lookup.where_filter(F.col("text"), {"The": "OF", "": ""})).select("doc_id", "lang")


@query(
    """SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN false WHEN l.toxic = 0 THEN true WHEN d.source = 'src1' THEN true WHEN d.source = 'src2' THEN false ELSE true END AS allowed
FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def acl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents deny everyone and others in labels allow; src1 allows readers, src2 only admins; the default has no say."""
    names = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    per_doc = table(spark, sf_dir, "labels").select(F.lit("document").alias("level"), F.col("doc_id").cast("string").alias("key"), F.when(F.col("toxic") == 0, names("role:reader")).otherwise(names()).alias("allow"), F.when(F.col("toxic") == 1, names("*")).otherwise(names()).alias("deny"))
    rest = spark.createDataFrame([("collection", "src1", ["role:reader"], []), ("collection", "src2", ["role:admin"], []), ("default", "*", [], [])], per_doc.schema)
    return lookup.allowed(table(spark, sf_dir, "documents").select("doc_id", "source"), per_doc.unionByName(rest), ["role:reader"], "source").select("doc_id", "allowed")


@query("SELECT page_id, url FROM pages WHERE url LIKE 'https://m.%' OR url LIKE 'http://ththre.example.com/fr/%'")
def path_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(F.col("url").startswith("https://m.") | lookup.under_roots(F.col("url"), ["http://ththre.example.com/fr/"])).select("page_id", "url")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as hits: every third has no final score, every seventh a final score of 0, every fifth no time."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.col("doc_id").alias("chunk_id"), "text", F.concat(F.lit("/"), "source").alias("path"), F.round(F.col("n_chars") / 7.0, 6).alias("score"),
        F.when(F.col("doc_id") % 7 == 0, 0.0).when(F.col("doc_id") % 3 != 0, F.round(F.col("n_chars") / 11.0, 6)).alias("final_score"),
        F.when(F.col("doc_id") % 5 == 0, 0).otherwise(F.lit(1700000000) + F.col("doc_id") * 60).alias("mtime"), F.array("lang").alias("types"), F.lit("semantic").alias("route"),
    )


@query(
    """SELECT doc_id, doc_id AS chunk_id, text, '/' || source AS path, CASE WHEN doc_id % 7 <> 0 AND doc_id % 3 <> 0 THEN round(n_chars / 11.0, 6) ELSE round(n_chars / 7.0, 6) END AS score, 'semantic' AS route,
CASE WHEN doc_id % 5 <> 0 THEN strftime(to_timestamp(1700000000 + doc_id * 60) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') END AS mtime FROM documents"""
)
def profile_slim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.profiled(_hits(spark, sf_dir), "slim")


@query(
    """SELECT doc_id, doc_id AS chunk_id, text, '/' || source AS path, round(n_chars / 7.0, 6) AS score, CASE WHEN doc_id % 7 = 0 THEN 0.0 WHEN doc_id % 3 <> 0 THEN round(n_chars / 11.0, 6) END AS final_score,
'semantic' AS route, lang AS types, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1700000000 + doc_id * 60 END AS mtime FROM documents"""
)
def profile_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.profiled(_hits(spark, sf_dir), "full").withColumn("types", F.array_join("types", ","))


_STOP = ", ".join(f"'{x}'" for x in dict.fromkeys(corpus.STOPWORDS))
_CONCEPTS = f"""w AS (SELECT doc_id, word, i FROM (SELECT doc_id, unnest(x) AS word, unnest(range(len(x))) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z0-9_\\-/]{{2,}}') AS x FROM documents)) WHERE word NOT IN ({_STOP})),
k AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS k FROM (SELECT doc_id, word, count(*) AS n, min(i) AS i FROM w GROUP BY ALL)),
cc AS (SELECT doc_id, string_agg(substr(word, 1, 48), ' ' ORDER BY k) AS concepts, count(*) AS n FROM k WHERE k <= 8 GROUP BY doc_id)"""


@query(
    f"""WITH {_CONCEPTS} SELECT doc_id, substr(translate(trim(text), chr(10), ' '), 1, 320) AS summary, concepts,
round(least(1.0, CASE WHEN trim(text) <> '' THEN 0.4 ELSE 0.0 END + least(0.4, 0.05 * coalesce(n, 0)) + 0.2), 3)::DOUBLE AS quality FROM documents LEFT JOIN cc USING (doc_id)"""
)
def doc_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = docs.select("doc_id", "text").join(corpus.concepts(docs), "doc_id", "left")
    n = F.coalesce(F.size("concepts"), F.lit(0))
    return out.select("doc_id", corpus.summary(F.col("text")).alias("summary"), F.array_join("concepts", " ").alias("concepts"), corpus.quality_score(F.trim("text") != "", F.greatest(n, F.lit(0))).alias("quality"))


@query(f"WITH {_CHUNKS} SELECT doc_id, substr(string_agg(text, ' ' ORDER BY chunk_start), 1, 600) AS summary, count(*) AS n_chunks FROM c GROUP BY doc_id")
def section_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.section_summaries(_chunks(spark, sf_dir), ["doc_id"], "chunk_start")


@query("SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'tion the')")
def summary_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("tion the"))).select("doc_id", "n_chars")


# At volume, parts stand for entities and orders for documents.
_MENTIONS = "m AS (SELECT l_partkey AS entity, l_orderkey AS doc_id FROM lineitem)"
_TFIDF = f"""{_MENTIONS}, per AS (SELECT entity, doc_id, count(*) AS tf FROM m GROUP BY ALL), nd AS (SELECT count(DISTINCT doc_id) AS n FROM m),
t AS (SELECT entity, count(*) AS df, sum(tf)::BIGINT AS total, max(tf) AS max_tf, avg(tf) AS mean FROM per GROUP BY entity),
s AS (SELECT entity, df, total, max_tf, round(mean, 6) AS mean_tf, round(0.7 * ln(1 + max_tf) * ln((n + 1) / (df + 1)) + 0.3 * ln(1 + mean) * ln((n + 1) / (df + 1)), 6) AS tfidf FROM t, nd)"""


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("doc_id"))


@query(f"WITH {_TFIDF} SELECT * FROM s")
def entity_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.tf_idf(_mentions(spark, sf_dir))


@query(
    f"""WITH {_TFIDF}, b AS (SELECT *, CASE WHEN df = 1 THEN '1' WHEN df <= 5 THEN '2-5' ELSE '6+' END AS df_bucket FROM s),
r AS (SELECT entity, df_bucket, row_number() OVER (PARTITION BY df_bucket ORDER BY tfidf DESC, entity) AS bucket_rank, count(*) OVER (PARTITION BY df_bucket) AS n FROM b)
SELECT entity, df_bucket, bucket_rank, bucket_rank <= floor(n * 75 / 100) AS kept FROM r"""
)
def df_bucket_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bucketed(graph.tf_idf(_mentions(spark, sf_dir)), 75).select("entity", "df_bucket", "bucket_rank", "kept")


@query("SELECT p_partkey AS id, p_type AS type FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def orphan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(used, "p_partkey", "left_anti").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"))


@query("SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT p_type AS type, count(*) AS n FROM part GROUP BY ALL")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("type")).agg(F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, l_returnflag AS type FROM lineitem UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey, 'supplies_' || l_linestatus FROM lineitem WHERE l_returnflag = 'R'),
n AS (SELECT 's' || s_suppkey AS id, s_name AS label FROM supplier UNION ALL SELECT 'p' || p_partkey, p_name FROM part)
(SELECT 'out' AS direction, type, dst AS id, label FROM e JOIN n ON id = dst WHERE src = 'p7' ORDER BY type, id LIMIT 20)
UNION ALL (SELECT 'in', type, src, label FROM e JOIN n ON id = src WHERE dst = 'p7' ORDER BY type, id LIMIT 20)"""
)
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier = F.concat(F.lit("p"), F.col("l_partkey")), F.concat(F.lit("s"), F.col("l_suppkey"))
    lines = table(spark, sf_dir, "lineitem")
    nodes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.col("s_name").alias("label"))
    nodes = nodes.unionByName(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.col("p_name").alias("label")))
    sold = lines.select(part.alias("src"), supplier.alias("dst"), F.col("l_returnflag").alias("type"))
    edges = sold.unionByName(lines.where("l_returnflag = 'R'").select(supplier.alias("src"), part.alias("dst"), F.concat(F.lit("supplies_"), "l_linestatus").alias("type")))
    return graph.neighbours(nodes, edges.distinct(), "p7", 20)


@query("SELECT p_partkey AS id, lower(p_name) AS label, p_type AS type FROM part WHERE contains(lower(p_name), 'r') AND p_type NOT IN ('PROMO', 'SMALL') ORDER BY label, id LIMIT 100")
def entity_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("label"), F.col("p_type").alias("type"))
    return rows.where(F.contains("label", F.lit("r")) & ~F.col("type").isin("PROMO", "SMALL")).orderBy("label", "id").limit(100)


@query("SELECT DISTINCT o_orderkey AS doc_id, o_orderpriority AS label FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey = 7 ORDER BY doc_id, label LIMIT 200")
def linkouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").where("l_partkey = 7").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return table(spark, sf_dir, "orders").join(hits, "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("label")).orderBy("doc_id", "label").limit(200)


@query("SELECT l_partkey AS id, arg_max(l_shipmode, seq) AS label, string_agg(DISTINCT l_suppkey, ',' ORDER BY l_suppkey) AS doc_ids FROM (SELECT l_partkey, l_suppkey, l_returnflag AS l_shipmode, l_orderkey * 10 + l_linenumber AS seq FROM lineitem) GROUP BY l_partkey")
def node_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("label"), F.lit("entity").alias("type"), F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return graph.merged_nodes(rows).select("id", "label", F.array_join("doc_ids", ",").alias("doc_ids"))


_INDEX = "SELECT doc_id, doc_id * 1000 AS mtime_ns, n_chars + (doc_id % 5 = 0)::INT AS file_size FROM documents WHERE doc_id % 7 <> 0"


@query(f"SELECT d.doc_id, CASE WHEN i.doc_id IS NULL THEN 'new' WHEN i.file_size = d.n_chars THEN 'same' ELSE 'changed' END AS state FROM documents d LEFT JOIN ({_INDEX}) i USING (doc_id)")
def incremental_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that misses each seventh document and has another size for each fifth."""
    files = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") * 1000).alias("mtime_ns"), F.col("n_chars").alias("file_size"))
    index = files.where("doc_id % 7 <> 0").withColumn("file_size", F.col("file_size") + (F.col("doc_id") % 5 == 0).cast("int"))
    return corpus.changed(files, index).select("doc_id", "state")


@query("SELECT o_custkey AS key, max(o_orderkey) AS version FROM orders GROUP BY ALL UNION ALL SELECT c_custkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit(0).cast("long").alias("version"), F.col("c_name").alias("text"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("text"))
    return corpus.upserted(old, new, "key", "version").select("key", "version")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.deleted(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").where("toxic = 1"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def existence_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.known_rows(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT a.c_name AS name, a.c_nationkey AS size FROM customer a WHERE NOT EXISTS (SELECT 1 FROM customer b WHERE b.c_custkey % 3 = 0 AND lower(a.c_name) = lower(upper(b.c_name)) AND a.c_nationkey = b.c_nationkey)")
def directory_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("size"), "c_custkey")
    return corpus.missing_files(left.drop("c_custkey"), left.where("c_custkey % 3 = 0").select(F.upper("name").alias("name"), "size"))


@query(
    """WITH s AS (SELECT source, count(*) AS block_count, sum((contains(text, '|'))::INT)::BIGINT AS table_blocks, 0::BIGINT AS heading_blocks, sum(length(text))::BIGINT AS text_chars, count(DISTINCT lang) AS page_count FROM documents GROUP BY source)
SELECT source, block_count, text_chars, page_count, concat_ws('; ', CASE WHEN block_count < 50 THEN 'min_blocks:' || block_count || '<50' END, CASE WHEN text_chars < 100000 THEN 'min_text_chars:' || text_chars || '<100000' END,
CASE WHEN table_blocks = 0 THEN 'expect_tables:true but no table blocks detected' END) AS issues FROM s"""
)
def extraction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as extractions, documents as blocks, languages as pages."""
    stats = table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("block_count"), F.sum(F.contains("text", F.lit("|")).cast("long")).alias("table_blocks"), F.lit(0).cast("long").alias("heading_blocks"), F.sum(F.length("text").cast("long")).alias("text_chars"), F.countDistinct("lang").alias("page_count")
    )
    out = corpus.extraction_issues(stats, min_blocks=50, min_text_chars=100000, expect_tables=True)
    return out.select("source", "block_count", "text_chars", "page_count", F.array_join("issues", "; ").alias("issues"))


@query(f"WITH {_CHUNKS} SELECT doc_id, count(*) AS n_chunks, round(avg(length(text)), 4) AS avg_chars, max(chunk_end) AS chars FROM c GROUP BY doc_id")
def chunk_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.round(F.avg(F.length("text")), 4).alias("avg_chars"), F.max("chunk_end").alias("chars"))


_GOLDQ = "list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]{3,}'))"


@query(
    f"""WITH {_ITEM_TERMS}, {_BM25}, best AS (SELECT query_id, chunk_id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS rank FROM scored),
p AS (SELECT b.item_id, d.doc_id, d.text, {_GOLDQ} AS q FROM best JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 8)
SELECT item_id, doc_id, round(CASE WHEN len(q) > 0 THEN len(list_filter(q, lambda w: contains(lower(text), w))) / len(q) ELSE 0.0 END, 4) AS coverage FROM p"""
)
def hit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 8 lexical hits of every benchmark item among all documents: the share of its tokens in each."""
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    best = _of_items(spark, sf_dir, 8)
    hits = best.select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"))
    rows = hits.join(docs.select("doc_id", "text"), "doc_id").join(items.select("item_id", text.quality_tokens(F.col("text")).alias("q")), "item_id")
    return rows.select("item_id", "doc_id", F.round(text.coverage(F.col("q"), F.col("text")), 4).alias("coverage"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Za-z0-9%°μ/+-]{2,}')[1:12], ' ') AS snippet FROM documents")
def gold_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", corpus.snippet(F.col("text")).alias("snippet"))


@query("SELECT event_id, array_to_string(regexp_extract_all(props, '\\d+'), ',') AS pages FROM events")
def page_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.array_join(text.pages_of(F.col("props")).cast("array<string>"), ",").alias("pages"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS label, CASE WHEN regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') = '' THEN 'unknown' ELSE regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END AS slug FROM part")
def label_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.normalise_label(F.col("p_name")).alias("label"), text.slug(F.col("p_name")).alias("slug"))
