"""Registered queries of the routes, the unified search, hydration, lookups and quality gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import corpus, ingest, lookup, retrieval, routes
from ..operators.index import query_units
from ..sources import store
from .search import _BM25, _HYBRID, _ITEM_TERMS, _QTOK, _WEIGHT, _both, _dense, _of_items, index_of, query, table

# Attributes of chunks: an age from the id, a prior from labels.quality, a boost from labels.toxic.
_ATTRS = """attrs AS (SELECT doc_id AS chunk_id, (doc_id % 400)::DOUBLE AS age_days, CASE quality WHEN 1 THEN 0.2 WHEN 0 THEN -0.2 END AS delta, CASE WHEN toxic = 1 THEN 0.5 END AS boost
  FROM documents LEFT JOIN labels USING (doc_id))"""
_MULT = "(coalesce(0.85 + 0.15 * pow(2, -age_days / 180.0), 1) * greatest(0.1, 1 + coalesce(delta, 0)) * greatest(0.0, coalesce(boost, 1)))"
_NORMED = "CASE WHEN {0} IS NULL OR max({0}) OVER w - min({0}) OVER w < 1e-9 THEN 0.0 ELSE round(({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w), 6) END"
_RERANK = "(((item * 37 + query_id * 11) % 101) / 101.0)"


def _attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    delta = F.when(F.col("quality") == 1, 0.2).when(F.col("quality") == 0, -0.2)
    return docs.select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 400).cast("double").alias("age_days"), delta.alias("delta"), F.when(F.col("toxic") == 1, 0.5).alias("boost"))


def _stand_in(rows: DataFrame) -> DataFrame:
    """A deterministic stand-in for a reranker's scores."""
    return rows.select("query_id", "chunk_id", (((F.col("chunk_id") * 37 + F.col("query_id") * 11) % 101) / 101.0).alias("rerank"))


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense candidates of all items; routes that need no lexical ones build no index."""
    return _dense(spark, sf_dir).withColumnRenamed("item", "chunk_id")


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dense and lexical candidates of all items, and both fused."""
    dense, lexical = (x.withColumnRenamed("item", "chunk_id") for x in _both(spark, sf_dir))
    fused = retrieval.rrf(dense, lexical, item="chunk_id")
    fused = fused.join(dense.drop("rank"), ["query_id", "chunk_id"], "left").join(lexical.drop("rank"), ["query_id", "chunk_id"], "left")
    return dense, lexical, fused


_OUT = ["query_id", "chunk_id", "rank", "final_score", "route"]


@query(_HYBRID + f", {_ATTRS} SELECT query_id, item AS chunk_id, rank, round(dense * {_MULT}, 9) AS final_score, 'semantic' AS route FROM den LEFT JOIN attrs ON chunk_id = item WHERE rank <= 8")
def route_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.semantic(_near(spark, sf_dir), _attrs(spark, sf_dir), top_k=10, return_k=8).select(_OUT)


_SPARSE_ROUTE = f"""l16 AS (SELECT query_id, item, bm25, rank, {_NORMED.format("bm25")} AS norm FROM lex WHERE rank <= 16 WINDOW w AS (PARTITION BY query_id)),
sparse_rows AS (SELECT query_id, item AS chunk_id, rank, round(0.2 * norm / 1.0 * {_MULT}, 9) AS final_score, 'sparse' AS route FROM l16 LEFT JOIN attrs ON chunk_id = item WHERE rank <= 8)"""


@query(_HYBRID + f", {_ATTRS}, {_SPARSE_ROUTE} SELECT * FROM sparse_rows")
def route_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.sparse(_of_items(spark, sf_dir, 16), _attrs(spark, sf_dir), retrieve_k=24, return_k=8).select(_OUT)


_RERANK_DOWN = f"SELECT query_id, item AS chunk_id, rank, round(dense * {_MULT}, 9) AS final_score, 'rerank' AS route FROM den LEFT JOIN attrs ON chunk_id = item WHERE rank <= 10"
_HYBRID_DOWN = f"SELECT query_id, item AS chunk_id, rank, round(rrf * {_MULT}, 9) AS final_score, 'hybrid' AS route FROM r LEFT JOIN attrs ON chunk_id = item WHERE rank <= 10"


@query(_HYBRID + f", {_ATTRS} {_RERANK_DOWN}")
def route_rerank_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.rerank(_near(spark, sf_dir), _attrs(spark, sf_dir), retrieve_k=24, return_k=8, top_k=10).select(_OUT)


@query(_HYBRID + f", {_ATTRS} {_HYBRID_DOWN}")
def route_hybrid_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.hybrid(_candidates(spark, sf_dir)[2], _attrs(spark, sf_dir), retrieve_k=24, return_k=8, top_k=10).select(_OUT)


def _blended(rows: str, signals: dict[str, float], route: str) -> str:
    norms = ", ".join(f"{_NORMED.format(s)} AS {s}_norm" for s in signals)
    total = " + ".join(f"{w} * {s}_norm" for s, w in signals.items())
    return f""", {_ATTRS}, x AS (SELECT *, {_RERANK} AS rerank FROM {rows} WHERE rank <= 16), n AS (SELECT query_id, item, rank AS raw, {norms} FROM x WINDOW w AS (PARTITION BY query_id)),
s AS (SELECT query_id, item AS chunk_id, raw, round(({total}) / 1.0 * {_MULT}, 9) AS final_score FROM n LEFT JOIN attrs ON chunk_id = item),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, raw, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, rank, final_score, '{route}' AS route FROM k WHERE rank <= 8"""


@query(_HYBRID + _blended("den", {"dense": 0.3, "rerank": 0.5}, "rerank"))
def route_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = _near(spark, sf_dir)
    return routes.rerank(dense, _attrs(spark, sf_dir), 24, 8, 10, _stand_in(dense)).select(_OUT)


@query(_HYBRID + _blended("r", {"bm25": 0.2, "dense": 0.3, "rerank": 0.5}, "hybrid"))
def route_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = _candidates(spark, sf_dir)[2]
    return routes.hybrid(fused, _attrs(spark, sf_dir), 24, 8, 10, _stand_in(fused)).select(_OUT)


_MAXSIM = """q AS (SELECT vec_id // 100 AS query_id, vec_id AS t, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
b AS (SELECT query_id, t, e.vec_id // 8 AS chunk_id, max(list_dot_product(q.v, e.embedding::DOUBLE[])) AS best FROM q, embeddings e GROUP BY ALL),
sims AS (SELECT query_id, chunk_id, round(sum(best), 6) AS score FROM b GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sims)"""


@query(
    f"""WITH {_MAXSIM}, {_ATTRS}, n AS (SELECT query_id, chunk_id, rank, {_NORMED.format("score")} AS norm FROM ranked WHERE rank <= 24 WINDOW w AS (PARTITION BY query_id))
SELECT query_id, n.chunk_id, rank, round(0.3 * norm / 1.0 * {_MULT}, 9) AS final_score, 'colbert' AS route FROM n LEFT JOIN attrs USING (chunk_id) WHERE rank <= 8"""
)
def late_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight vectors in a row are a chunk's tokens; the vectors whose id 50 divides are queries' tokens, two each."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 50 = 0").select(F.floor(F.col("vec_id") / 100).alias("id"), F.col("embedding").alias("vector"))
    tokens = vectors.select(F.floor(F.col("vec_id") / 8).alias("id"), F.col("embedding").alias("vector"))
    ranked = retrieval.top_k(retrieval.max_sim(queries, tokens), 24, "query_id", "score", "chunk_id")
    return routes.late(ranked, _attrs(spark, sf_dir), 24, 8).select(_OUT)


_ASKED = """asked AS (SELECT item_id AS query_id, CASE WHEN item_id % 13 = 5 THEN ' ' ELSE text END AS text, (['auto', 'semantic', 'sparse', 'hybrid', 'rerank', 'bogus'])[item_id % 6 + 1] AS mode,
  CASE WHEN item_id % 11 = 0 THEN 30 ELSE 8 END AS return_k FROM benchmark),
checked AS (SELECT *, CASE WHEN trim(text) = '' THEN 'empty_query' WHEN mode = 'bogus' THEN 'invalid_mode' WHEN return_k > 24 THEN 'invalid_return_k' END AS error,
  CASE WHEN mode <> 'auto' THEN mode WHEN nw <= 3 AND NOT contains(text, '?') THEN 'sparse' WHEN nw <= 4 AND regexp_matches(text, '[A-Z]') THEN 'hybrid' WHEN contains(text, '?') OR nw > 10 THEN 'rerank' ELSE 'hybrid' END AS route
  FROM (SELECT *, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) AS nw FROM asked))"""
_UNIFIED = f"""{_ASKED}, {_ATTRS}, {_SPARSE_ROUTE},
hits AS (SELECT x.* FROM (SELECT query_id, item AS chunk_id, rank, round(dense * {_MULT}, 9) AS final_score, 'semantic' AS route FROM den LEFT JOIN attrs ON chunk_id = item WHERE rank <= 8
  UNION ALL SELECT * FROM sparse_rows UNION ALL {_RERANK_DOWN} UNION ALL {_HYBRID_DOWN}) x JOIN checked c ON c.query_id = x.query_id AND c.route = x.route WHERE error IS NULL),
bests AS (SELECT query_id, greatest(0.0, max(final_score)) AS best FROM hits GROUP BY ALL),
state0 AS (SELECT b.query_id, b.route, coalesce(best, 0.0) AS best, f.chunk_id IS NOT NULL AS found, d.text AS t, {_QTOK} AS q FROM checked b LEFT JOIN bests USING (query_id)
  LEFT JOIN (SELECT query_id, chunk_id FROM hits WHERE rank = 1) f USING (query_id) LEFT JOIN documents d ON d.doc_id = f.chunk_id WHERE error IS NULL),
state AS (SELECT query_id, best, best < 0.02 AS abstains, best >= 0.02 AND route <> 'sparse' AND NOT (found AND NOT CASE WHEN best >= 0.35 OR len(q) = 0 THEN false WHEN coalesce(t, '') = '' THEN true WHEN share < 0.25 THEN true ELSE share < 0.4 AND best < 0.2 END) AS retries
  FROM (SELECT *, CASE WHEN len(q) > 0 THEN len(list_filter(q, lambda w: contains(lower(t), w))) / len(q) ELSE 1.0 END AS share FROM state0)),
second AS (SELECT s.*, greatest(0.0, max(final_score) OVER (PARTITION BY query_id)) AS best FROM sparse_rows s SEMI JOIN (SELECT query_id FROM state WHERE retries) USING (query_id))
SELECT query_id, 'hit' AS kind, route, rank, chunk_id, final_score, best, NULL AS detail FROM hits JOIN state USING (query_id) WHERE NOT abstains AND query_id NOT IN (SELECT query_id FROM second)
UNION ALL SELECT query_id, 'hit', route, rank, chunk_id, final_score, best, NULL FROM second
UNION ALL SELECT query_id, 'abstain', NULL, NULL, NULL, NULL, best, 'low_answerability' FROM state WHERE abstains
UNION ALL SELECT query_id, 'error', NULL, NULL, NULL, NULL, NULL, error FROM checked WHERE error IS NOT NULL"""


def _routes(spark: SparkSession, sf_dir: str):
    """Route name to function of the queries; all share the candidates of the items, written once."""
    dense, lexical, fused = _candidates(spark, sf_dir)
    fused = store.written(fused, "candidates")
    attrs = _attrs(spark, sf_dir)
    of = lambda rows, q: rows.join(q.select("query_id"), "query_id", "left_semi")
    return {
        "semantic": lambda q: routes.semantic(of(dense, q), attrs, 10, 8),
        "sparse": lambda q: routes.sparse(of(lexical, q), attrs, 24, 8),
        "rerank": lambda q: routes.rerank(of(dense, q), attrs, 24, 8, 10),
        "hybrid": lambda q: routes.hybrid(of(fused, q), attrs, 24, 8, 10),
    }


@query(_HYBRID + f", {_UNIFIED}")
def unified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item as a query in one of six modes, some of them at fault, abstaining under 0.02."""
    i = F.col("item_id")
    queries = table(spark, sf_dir, "benchmark").select(
        i.alias("query_id"), F.when(i % 13 == 5, " ").otherwise(F.col("text")).alias("text"), F.get(F.array(*map(F.lit, ("auto", "semantic", "sparse", "hybrid", "rerank", "bogus"))), (i % 6).cast("int")).alias("mode"),
        F.lit(10).alias("top_k"), F.lit(24).alias("retrieve_k"), F.when(i % 11 == 0, 30).otherwise(8).alias("return_k"),
    )
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return routes.unified(queries, _routes(spark, sf_dir), texts, threshold=0.02)


@query(_HYBRID + f", {_ASKED}, {_ATTRS} SELECT x.* FROM ({_RERANK_DOWN} UNION ALL {_HYBRID_DOWN}) x JOIN checked c ON c.query_id = x.query_id AND c.route = x.route")
def dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by their planned route, for the two routes named."""
    i = F.col("item_id")
    queries = table(spark, sf_dir, "benchmark").select(i.alias("query_id"), F.when(i % 13 == 5, " ").otherwise(F.col("text")).alias("text"), F.get(F.array(*map(F.lit, ("auto", "semantic", "sparse", "hybrid", "rerank", "bogus"))), (i % 6).cast("int")).alias("mode"), F.lit(24).alias("retrieve_k"), F.lit(8).alias("return_k"))
    chosen = {k: v for k, v in _routes(spark, sf_dir).items() if k in ("rerank", "hybrid")}
    return routes.dispatched(routes.planned(queries), chosen).select(_OUT)


@query(
    f"""WITH {_ITEM_TERMS}, {_BM25}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS rank FROM scored)
SELECT query_id, chunk_id, bm25, CASE WHEN coalesce(toxic, 0) = 0 THEN text END AS text, CASE WHEN chunk_id % 2 = 0 THEN 'own' ELSE source END AS source, coalesce(toxic, 0) = 1 AS forbidden, CASE WHEN toxic = 1 THEN 'access_denied' END AS reason
FROM h JOIN documents d ON d.doc_id = chunk_id LEFT JOIN labels l ON l.doc_id = chunk_id WHERE rank <= 8"""
)
def hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical hits without texts, half with an empty source, filled from documents; toxic ones are forbidden."""
    hits = _of_items(spark, sf_dir, 8).drop("rank")
    hits = hits.withColumn("source", F.when(F.col("chunk_id") % 2 == 0, "own").otherwise(""))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", "source", "text")
    may = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") != 1).alias("allowed"))
    return routes.hydrated(hits, ingest.thin(chunks, "lang"), allowed=may).drop("doc_id")


@query(
    """WITH a AS (SELECT doc_id AS ask_id, doc_id + CASE WHEN doc_id % 17 = 0 THEN 1000000000 ELSE 0 END AS want FROM labels)
SELECT ask_id, d.doc_id AS chunk_id, d.doc_id AS doc_id, CASE WHEN d.doc_id IS NULL OR l.toxic = 1 OR NOT (source = 'src1' OR source = 'src2' OR source = 'src3') THEN NULL ELSE substr(text, (ask_id % 50 + 1)::BIGINT, 40) END AS text,
CASE WHEN d.doc_id IS NULL THEN 'not_found' WHEN l.toxic = 1 OR NOT (source = 'src1' OR source = 'src2' OR source = 'src3') THEN 'forbidden' ELSE 'found' END AS status
FROM a LEFT JOIN documents d ON d.doc_id = want LEFT JOIN labels l ON l.doc_id = want"""
)
def open_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled document asked for, by chunk where its id is even, else by element; three sources' paths are allowed, toxic ones denied."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chunks = docs.select("doc_id", F.col("doc_id").alias("chunk_id"), "text", F.array(F.concat(F.lit("e"), F.col("doc_id"))).alias("element_ids"), F.concat(F.lit("/"), "source").alias("path"), F.col("source").alias("collection"))
    want = F.col("doc_id") + F.when(F.col("doc_id") % 17 == 0, 1_000_000_000).otherwise(0)
    even = F.col("doc_id") % 2 == 0
    low = (F.col("doc_id") % 50).cast("int")
    asks = labels.select(F.col("doc_id").alias("ask_id"), F.when(even, want).alias("chunk_id"), F.when(~even, F.concat(F.lit("e"), want)).alias("element_id"), low.alias("start"), (low + 40).alias("end"))
    none = F.array().cast("array<string>")
    acl = labels.where("toxic = 1").select(F.lit("document").alias("level"), F.col("doc_id").cast("string").alias("key"), none.alias("allow"), F.array(F.lit("*")).alias("deny"))
    return lookup.opened(chunks, asks, acl, ("role:reader",), ("/src1", "/src2", "/src3/"))


@query("SELECT 's' || source AS element_id, min(doc_id) AS chunk_id FROM documents WHERE source <> 'src0' GROUP BY source")
def element_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.array(F.concat(F.lit("e"), F.col("doc_id")), F.concat(F.lit("s"), "source")).alias("element_ids"))
    return lookup.of_elements(chunks, docs.where("source <> 'src0'").select(F.concat(F.lit("s"), "source").alias("element_id")))


_ROWS = "(SELECT p_partkey AS doc_id, p_name || ' of ' || p_type || ' size ' || p_size AS text FROM part)"
_STOPPED = ", ".join(f"'{x}'" for x in corpus.TABLE_STOPWORDS)


@query(
    f"""WITH words AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS x FROM {_ROWS}),
toks AS (SELECT doc_id, unnest(x) AS term FROM words), lens AS (SELECT doc_id, len(x) AS len FROM words WHERE len(x) > 0), post AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM toks JOIN lens USING (doc_id) GROUP BY doc_id, term),
stats AS (SELECT count(*) AS n_docs, avg(len) AS avgdl FROM lens), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
terms AS (SELECT DISTINCT p_partkey AS query_id, unnest(list_filter(regexp_extract_all(lower('the ' || p_name || ' of ' || p_type), '[\\p{{L}}\\p{{N}}]+'), lambda t: len(t) > 2 AND t NOT IN ({_STOPPED}))) AS term FROM part WHERE p_partkey % 50 = 0),
scored AS (SELECT query_id, doc_id AS chunk_id, round(sum({_WEIGHT}), 6) AS bm25 FROM terms JOIN post USING (term) JOIN df USING (term), stats GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS k FROM scored) WHERE k <= 30),
kept AS (SELECT query_id, chunk_id, bm25 FROM top WHERE chunk_id % 3 = 0 AND EXISTS (SELECT 1 FROM part WHERE p_partkey = chunk_id))
SELECT query_id, chunk_id, bm25, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS rank FROM kept) WHERE rank <= 10"""
)
def table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as chunks, every third a table row; the parts whose key 50 divides as questions."""
    parts = table(spark, sf_dir, "part")
    chunks = parts.select(F.col("p_partkey").alias("chunk_id"), F.col("p_partkey").alias("doc_id"), F.expr("p_name || ' of ' || p_type || ' size ' || p_size").alias("text"), F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("Table_Row"))).otherwise(F.array(F.lit("para"))).alias("types"))
    asks = parts.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.expr("'the ' || p_name || ' of ' || p_type").alias("text"))
    index = index_of(spark, sf_dir, chunks.select("chunk_id", "text"), "part_rows", id_col="chunk_id")
    pool = routes.POOL * 10
    return routes.table_lookup(index.search(routes.table_units(asks), pool), index.search(query_units(asks), pool), chunks, 10, where={"size": ""})


_GATE_HITS = f"""{_SPARSE_ROUTE}, gh AS (SELECT s.query_id, s.rank, chunk_id % 7 AS doc_id, final_score AS score, chunk_id % 9 = 0 AS is_table, chunk_id % 4 <> 0 AS has_plan, len(list_filter(q, lambda w: contains(lower(t), w))) / len(q) AS coverage
  FROM (SELECT s.*, d.text AS t, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]{{3,}}')) AS q FROM sparse_rows s JOIN documents d ON d.doc_id = chunk_id JOIN benchmark b ON b.item_id = query_id) s)"""


def _gate_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    hits = route_sparse(spark, sf_dir).join(docs.select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id")
    hits = hits.join(items.select(F.col("item_id").alias("query_id"), text.quality_tokens(F.col("text")).alias("q")), "query_id")
    return hits.select(
        "query_id", "rank", (F.col("chunk_id") % 7).alias("doc_id"), F.col("final_score").alias("score"), text.coverage(F.col("q"), F.col("text")).alias("coverage"), "text",
        F.when(F.col("chunk_id") % 9 == 0, F.array(F.lit("table_row"))).otherwise(F.array(F.lit("para"))).alias("types"), F.when(F.col("chunk_id") % 4 != 0, "h").alias("plan_hash"),
    )


@query(
    _HYBRID
    + f""", {_ATTRS}, {_GATE_HITS}, flags AS (SELECT query_id, rank, unnest([CASE WHEN score < 0.05 THEN 'hit_' || (rank - 1) || '_score_below_min' END, CASE WHEN NOT has_plan THEN 'hit_' || (rank - 1) || '_missing_plan_hash' END]) AS f, unnest([1, 2]) AS o FROM gh),
ff AS (SELECT query_id, string_agg(f, ';' ORDER BY rank, o) AS f FROM flags WHERE f IS NOT NULL GROUP BY ALL), dup AS (SELECT query_id, count(*) FILTER (WHERE n > 1) AS duplicate_docs FROM (SELECT query_id, doc_id, count(*) AS n FROM gh GROUP BY ALL) GROUP BY ALL),
s AS (SELECT query_id, count(*) AS hits, min(score) AS score_min, max(score) AS score_max, round(avg(score), 4) AS score_avg, round(avg(coverage), 4) AS coverage_avg, max(coverage) AS cm, count(*) FILTER (WHERE is_table) AS table_hits FROM gh GROUP BY ALL)
SELECT query_id, hits, score_min, score_max, score_avg, coverage_avg, table_hits, duplicate_docs, concat_ws(';', f, CASE WHEN table_hits = 0 THEN 'missing_table_hit' END) AS failures,
concat_ws(';', CASE WHEN cm < 0.3 THEN 'low_query_coverage' END, CASE WHEN duplicate_docs > 0 THEN 'duplicate_doc_hits' END) AS warnings, f IS NULL AND table_hits > 0 AS passed FROM s JOIN dup USING (query_id) LEFT JOIN ff USING (query_id)"""
)
def hit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = routes.hit_gate(_gate_hits(spark, sf_dir), 0.05, ("plan_hash",), True)
    return out.withColumns({"failures": F.array_join("failures", ";"), "warnings": F.array_join("warnings", ";")}).drop("coverage_max")


@query(
    _HYBRID
    + f""", {_ATTRS}, {_GATE_HITS}, c AS (SELECT item_id AS query_id, 'c' || item_id % 5 AS collection, item_id % 7 AS want, row_number() OVER (PARTITION BY item_id % 5 ORDER BY item_id) AS k FROM benchmark)
SELECT collection, c.query_id, count(*) FILTER (WHERE doc_id = want) AS hits, count(*) FILTER (WHERE doc_id = want) >= 1 AS passed FROM c LEFT JOIN gh USING (query_id) WHERE k <= 6 GROUP BY ALL"""
)
def canaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as canaries of five collections, each to find a document of a number."""
    asks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("c"), F.col("item_id") % 5).alias("collection"), (F.col("item_id") % 7).alias("doc_id"), F.lit(1).alias("min_hits"))
    return routes.canaries(asks, _gate_hits(spark, sf_dir).select("query_id", "doc_id"))


@query(None)
def relevance_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy matching of each item's hits with three expectations; tests hold it against brute force."""
    i = F.col("item_id")
    kinds = [(1, i % 7, F.lit(None).cast("string"), 2.0), (2, F.lit(None).cast("long"), F.lit("The"), 1.0), (3, (i + 1) % 7, F.lit("of"), 0.5)]
    asks = F.array(*[F.struct(F.lit(n).cast("long").alias("expectation"), d.alias("doc_id"), c.alias("contains"), F.lit(g).alias("gain")) for n, d, c, g in kinds])
    expectations = table(spark, sf_dir, "benchmark").select(i.alias("query_id"), F.inline(asks))
    return corpus.matched_relevance(_gate_hits(spark, sf_dir), expectations)
