"""Registered retrieval queries and their DuckDB forms."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..functions.text import ACCENTED, PLAIN
from ..operators import lookup, retrieval, routes
from ..operators.index import LexicalIndex, query_units
from ..sources import store

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: The pinned present of decay queries.
NOW = "2024-02-01 00:00:00"


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MARKS = f"[{chr(0x300)}-{chr(0x36F)}]"
_TOKENS = f"regexp_extract_all(translate(regexp_replace(lower(text), '{_MARKS}', '', 'g'), '{ACCENTED}', '{PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"
_WEIGHT = """CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END
    * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avgdl))"""
_POSTINGS = f"""
words AS MATERIALIZED (SELECT doc_id, {_TOKENS} AS x FROM documents),
toks AS MATERIALIZED (SELECT doc_id, unnest(x) AS term FROM words),
lens AS MATERIALIZED (SELECT doc_id, len(x) AS len FROM words WHERE len(x) > 0),
post AS MATERIALIZED (SELECT doc_id, len, term, tf FROM (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY ALL) JOIN lens USING (doc_id)),
stats AS (SELECT count(*) AS n_docs, avg(len) AS avgdl FROM lens),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""
_BM25 = f"""{_POSTINGS},
scored AS (
  SELECT query_id, doc_id AS chunk_id, count(*) AS matched, round(sum({_WEIGHT}), 6) AS bm25
  FROM terms JOIN post USING (term) JOIN df USING (term), stats GROUP BY ALL
)"""
_ITEM_TERMS = f"terms AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark)"


def index_of(spark: SparkSession, sf_dir: str, chunks: DataFrame | None = None, name: str = "documents", **columns: str) -> LexicalIndex:
    """The lexical index of a table, in the shared folder; this application's first use builds it."""
    key = hashlib.sha1(f"{sf_dir}/{name}".encode()).hexdigest()[:12]
    path = f"{store.shared_dir(spark)}/quillmere-index/{spark.sparkContext.applicationId}-{key}"
    return LexicalIndex.opened(table(spark, sf_dir, name) if chunks is None else chunks, path, **columns)


def _lexical(spark: SparkSession, sf_dir: str, terms: DataFrame, k: int) -> DataFrame:
    """The k best documents of each query, with their rank."""
    return index_of(spark, sf_dir).any_term(terms, k)


def _of_items(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return _lexical(spark, sf_dir, retrieval.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text"), k)


@query(f"WITH {_POSTINGS} SELECT count(*) AS postings, sum(tf)::BIGINT AS tokens, count(DISTINCT term) AS terms, any_value(n_docs) AS n_docs, round(any_value(avgdl), 6) AS avgdl FROM post, stats")
def lexical_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the persisted index holds; builds it where there is none yet."""
    made = index_of(spark, sf_dir)
    rows = made.tokens()
    per = rows.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("postings"), F.count("*").alias("terms")).crossJoin(rows.agg(F.sum(F.size("tokens")).alias("tokens"))).select("postings", "tokens", "terms")
    return out.withColumns({"n_docs": F.lit(made.n_docs).cast("long"), "avgdl": F.round(F.lit(made.avgdl), 6)})


@query(f"WITH terms AS (SELECT 0 AS query_id, unnest(['the', 'thand', 'of', 'thou']) AS term), {_BM25} SELECT query_id, chunk_id, bm25, rank FROM (SELECT query_id, chunk_id, bm25, row_number() OVER (ORDER BY bm25 DESC, chunk_id) AS rank FROM scored) WHERE rank <= 16")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.range(1).select(F.lit(0).alias("query_id"), F.explode(F.array(*map(F.lit, ("the", "thand", "of", "thou")))).alias("term"))
    return _lexical(spark, sf_dir, terms, 16).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_ITEM_TERMS}, {_BM25} SELECT query_id, chunk_id, bm25, rank FROM (SELECT query_id, chunk_id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS rank FROM scored) WHERE rank <= 8")
def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_items(spark, sf_dir, 8).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH terms AS (SELECT 0 AS query_id, unnest(['the', 'of', 'with']) AS term), {_BM25} SELECT query_id, chunk_id, bm25 FROM scored WHERE matched = 3")
def fts_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).search(query_units(spark.createDataFrame([(0, "The of, with")], "query_id int, text string")))


@query(
    f"""WITH {_POSTINGS}, q AS (SELECT item_id AS query_id, {_TOKENS} AS w FROM benchmark),
units AS (SELECT query_id, 0 AS clause, w[k] AS phrase FROM q, (SELECT unnest([1, 2]) AS k) UNION ALL SELECT query_id, 1, w[3] || ' ' || w[4] FROM q WHERE len(w) >= 4),
pairs AS (SELECT DISTINCT phrase, string_split(phrase, ' ') AS p FROM units WHERE clause = 1),
big AS (SELECT doc_id, x[i] || ' ' || x[i + 1] AS phrase FROM (SELECT doc_id, x, unnest(range(1, len(x))) AS i FROM words)),
occ AS (SELECT phrase, doc_id, count(*) AS tf FROM big SEMI JOIN pairs USING (phrase) GROUP BY ALL UNION ALL SELECT term, doc_id, tf FROM post SEMI JOIN (SELECT DISTINCT phrase AS term FROM units WHERE clause = 0) USING (term)),
dfs AS (SELECT phrase, count(*) AS df FROM occ GROUP BY ALL), sizes AS (SELECT query_id, clause, count(*) AS size FROM units WHERE phrase IS NOT NULL GROUP BY ALL),
met AS (SELECT query_id, clause, doc_id, size, sum({_WEIGHT}) AS w, count(*) AS n FROM units JOIN sizes USING (query_id, clause) JOIN dfs USING (phrase) JOIN occ USING (phrase) JOIN lens USING (doc_id), stats GROUP BY ALL)
SELECT query_id, doc_id AS chunk_id, round(sum(w), 6) AS bm25 FROM met WHERE n = size GROUP BY ALL"""
)
def fts_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's first two words, both, or its third and fourth as a phrase."""
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.index_tokens(F.col("text")).alias("w"))
    single = words.select("query_id", F.lit(0).alias("clause"), F.explode(F.slice("w", 1, 2)).alias("t")).select("query_id", "clause", F.array("t").alias("terms"))
    pair = words.where("size(w) >= 4").select("query_id", F.lit(1).alias("clause"), F.slice("w", 3, 2).alias("terms"))
    return index_of(spark, sf_dir).search(single.unionByName(pair))


_SPARSE = "regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_\\-/]{2,}')"


@query(
    f"""WITH d0 AS MATERIALIZED (SELECT doc_id, {_SPARSE} AS x FROM documents), d AS (SELECT doc_id, len(x) AS total, unnest(x) AS term FROM d0),
dw AS (SELECT doc_id, term, round(ln(1 + count(*)) / total, 9) AS weight FROM d GROUP BY doc_id, term, total),
q0 AS MATERIALIZED (SELECT item_id, {_SPARSE} AS x FROM benchmark), q AS (SELECT item_id, len(x) AS total, unnest(x) AS term FROM q0),
qw AS (SELECT item_id, term, round(ln(1 + count(*)) / total, 9) AS weight FROM q GROUP BY item_id, term, total),
s AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(sum(dw.weight * qw.weight), 6) AS score FROM qw JOIN dw USING (term) GROUP BY ALL)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 8"""
)
def sparse_tf_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = retrieval.sparse_weights(table(spark, sf_dir, "benchmark"), "item_id", "text")
    d = retrieval.sparse_weights(table(spark, sf_dir, "documents"), "doc_id", "text")
    return retrieval.top_k(retrieval.sparse_dot(q, d, "item_id", "doc_id"), 8, "query_id", "score", "chunk_id").withColumn("rank", F.col("rank").cast("long"))


_Q50 = "(SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0)"
_KNN = """SELECT query_id, vec_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT query_id, vec_id, round({0}, 6) AS score FROM {1}, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) WHERE vec_id <> query_id)) WHERE rank <= 10"""


def _knn(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        vectors = table(spark, sf_dir, "embeddings")
        out = retrieval.knn(vectors.where("vec_id % 50 = 0"), vectors, 10, metric)
        return out.withColumn("rank", F.col("rank").cast("long"))

    run.__name__ = f"knn_{metric}"
    return run


for _metric, _formula in (("cosine", "list_cosine_similarity(q, v)"), ("dot", "list_dot_product(q, v)"), ("euclid", "-sqrt(list_sum(list_transform(list_zip(q, v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))")):
    query(_KNN.format(_formula, _Q50))(_knn(_metric))


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x / n)), 6) AS norm2, round(embedding[1]::DOUBLE / sqrt(n), 6) AS first FROM (SELECT *, list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) AS n FROM embeddings)")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "embeddings").select("vec_id", retrieval.l2_normalised(F.col("embedding")).alias("v"))
    return out.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"), F.round(F.element_at("v", 1), 6).alias("first"))


_HYBRID = f"""WITH {_ITEM_TERMS}, {_BM25},
lex AS (SELECT query_id, chunk_id AS item, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS rank FROM scored),
den AS (SELECT query_id, item, dense, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, item) AS rank FROM (
  SELECT q.vec_id AS query_id, d.vec_id AS item, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS dense
  FROM embeddings q JOIN benchmark ON item_id = q.vec_id, embeddings d WHERE d.vec_id <> q.vec_id)),
f AS (SELECT coalesce(den.query_id, lex.query_id) AS query_id, coalesce(den.item, lex.item) AS item, den.rank AS rank_0, lex.rank AS rank_1, dense, bm25
  FROM (SELECT * FROM den WHERE rank <= 16) den FULL JOIN (SELECT * FROM lex WHERE rank <= 16) lex ON den.query_id = lex.query_id AND den.item = lex.item),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, rank_0 NULLS LAST, rank_1 NULLS LAST, item) AS rank FROM (SELECT *, round(coalesce(1.0 / (60 + rank_0), 0) + coalesce(1.0 / (60 + rank_1), 0), 9) AS rrf FROM f))
"""


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 16 of the dense route for every benchmark item (vec_id = doc_id), written once."""
    items, vectors = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    queries = vectors.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    found = retrieval.knn(queries, vectors, 16).select("query_id", F.col("vec_id").alias("item"), F.col("score").alias("dense"), "rank")
    return store.written(found, "dense")


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Top 16 of each route for every benchmark item: dense and lexical."""
    return _dense(spark, sf_dir), _of_items(spark, sf_dir, 16).withColumnRenamed("chunk_id", "item")


@query(_HYBRID + "SELECT query_id, item, rrf, rank_0, rank_1, rank FROM r WHERE rank <= 8")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rrf(*_both(spark, sf_dir)).where("rank <= 8")


_NORM = "CASE WHEN {0} IS NULL OR max({0}) OVER w - min({0}) OVER w < 1e-9 THEN 0.0 ELSE ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END"


@query(
    _HYBRID
    + f""", b AS (SELECT query_id, item, round({_NORM.format("bm25")}, 6) AS bm25_norm, round({_NORM.format("dense")}, 6) AS dense_norm FROM r WINDOW w AS (PARTITION BY query_id)),
s AS (SELECT b.*, round((0.2 * bm25_norm + 0.3 * dense_norm) / 1.0 * greatest(0.1, 1 + CASE quality WHEN 1 THEN 0.2 WHEN 0 THEN -0.2 ELSE 0 END), 9) AS score FROM b LEFT JOIN labels ON doc_id = item)
SELECT query_id, item, bm25_norm, dense_norm, score FROM s"""
)
def hybrid_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of both routes: normalised signals, blended, times the prior from labels.quality."""
    dense, lexical = _both(spark, sf_dir)
    rows = dense.drop("rank").join(lexical.drop("rank"), ["query_id", "item"], "full_outer")
    rows = rows.withColumns({f"{s}_norm": F.round(scoring.min_max(F.col(s), "query_id"), 6) for s in ("bm25", "dense")})
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), F.when(F.col("quality") == 1, 0.2).when(F.col("quality") == 0, -0.2).alias("delta"))
    score = scoring.blend(bm25=F.col("bm25_norm"), dense=F.col("dense_norm")) * scoring.prior(F.col("delta"))
    return rows.join(labels, "item", "left").select("query_id", "item", "bm25_norm", "dense_norm", F.round(score, 9).alias("score"))


@query(f"SELECT event_id, round(0.85 + 0.15 * pow(2, -((epoch(TIMESTAMP '{NOW}') - epoch(ts)) / 86400.0) / 180.0), 6) AS decay, round(pow(2, -((epoch(TIMESTAMP '{NOW}') - epoch(ts)) / 86400.0) / 30.0), 6) AS full_decay FROM events")
def time_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = (F.lit(NOW).cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")) / 86400.0
    return table(spark, sf_dir, "events").select("event_id", F.round(scoring.decay(age), 6).alias("decay"), F.round(scoring.decay(age, 30.0, 1.0), 6).alias("full_decay"))


@query("SELECT doc_id, round(greatest(0.1, 1 + (quality - 0.5) * 2.2) * CASE WHEN toxic = 1 THEN 0.0 ELSE 1.0 END, 6)::DOUBLE AS multiplier FROM labels")
def prior_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    boost = F.when(F.col("toxic") == 1, 0.0).otherwise(1.0)
    return table(spark, sf_dir, "labels").select("doc_id", F.round(scoring.prior((F.col("quality") - 0.5) * 2.2, boost), 6).alias("multiplier"))


@query(
    """WITH s AS (SELECT user_id, event_type, list(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END * (event_id % 7) / 4.0 ORDER BY ts, event_id) AS steps FROM events GROUP BY ALL),
f AS (SELECT user_id, event_type, list_reduce(list_prepend(0.0::DOUBLE, steps::DOUBLE[]), lambda a, x: least(4.0, greatest(-0.9, a + x))) AS p FROM s)
SELECT user_id, event_type, round(CASE WHEN abs(p) < 1e-6 THEN 0.0 ELSE p END, 6) AS prior FROM f"""
)
def session_prior_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as promotions and demotions, in time order, for each user and type: hours are folded apart and composed, so
    no row holds all events of a busy user."""
    step = F.when(F.col("event_id") % 3 == 0, -1).otherwise(1) * (F.col("event_id") % 7) / F.lit(4.0)
    ordered = lambda *x: F.array_sort(F.collect_list(F.struct(*x)))
    events = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    pieces = events.groupBy("user_id", "event_type", "hour").agg(scoring.clamped_sum(F.transform(ordered("ts", "event_id", step.alias("s")), lambda x: x["s"])).alias("p"))
    folded = scoring.composed_prior(F.transform(ordered("hour", "p"), lambda x: x["p"]))
    return pieces.groupBy("user_id", "event_type").agg(F.round(folded, 6).alias("prior"))


_N_WORDS = "len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> ''))"


@query(
    f"""SELECT conv_id, turn, CASE WHEN {_N_WORDS} <= 3 AND NOT contains(text, '?') THEN 'sparse' WHEN {_N_WORDS} <= 4 AND regexp_matches(text, '[A-Z]') THEN 'hybrid'
WHEN contains(text, '?') OR {_N_WORDS} > 10 THEN 'rerank' ELSE 'hybrid' END AS route,
CASE WHEN {_N_WORDS} <= 3 AND NOT contains(text, '?') THEN 24 WHEN {_N_WORDS} <= 4 AND regexp_matches(text, '[A-Z]') THEN 32 ELSE 24 END::INTEGER AS k FROM conversations"""
)
def route_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scoring.route(F.col("text")).alias("r")).select("conv_id", "turn", "r.route", "r.k")


_QTOK = "list_distinct(list_filter(regexp_extract_all(lower(b.text), '[a-z0-9]{3,}'), lambda x: len(x) >= 4))"


@query(
    f"""WITH {_ITEM_TERMS}, {_BM25}, best AS (SELECT query_id, arg_min(chunk_id, rank) AS chunk_id, max(bm25) AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS rank FROM scored) WHERE rank = 1 GROUP BY query_id),
x AS (SELECT b.item_id AS query_id, round(best / (best + 200), 6) AS best, {_QTOK} AS q, d.text AS t FROM benchmark b LEFT JOIN best ON query_id = item_id LEFT JOIN documents d ON d.doc_id = chunk_id),
c AS (SELECT *, CASE WHEN len(q) > 0 THEN len(list_filter(q, lambda w: contains(lower(t), w))) / len(q) ELSE 1.0 END AS share FROM x)
SELECT query_id, best, best IS NULL OR best < 0.25 AS abstain,
CASE WHEN best IS NULL THEN true WHEN best >= 0.35 OR len(q) = 0 THEN false WHEN coalesce(t, '') = '' THEN true WHEN share < 0.25 THEN true ELSE share < 0.4 AND best < 0.2 END AS retry,
array_to_string(list_sort(list_filter(q, lambda w: contains(lower(t), w)))[1:6], ' ') AS why FROM c"""
)
def retry_critic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best lexical hit of each item: score in 0 to 1, abstention, whether to retry, matched terms."""
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    best = _of_items(spark, sf_dir, 1)
    rows = items.select(F.col("item_id").alias("query_id"), F.filter(text.quality_tokens(F.col("text")), lambda x: F.length(x) >= 4).alias("q"))
    rows = rows.join(best, "query_id", "left").join(docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("t")), "chunk_id", "left")
    rows = rows.withColumn("best", F.round(F.col("bm25") / (F.col("bm25") + 200), 6))
    retry = scoring.needs_retry(F.col("best"), F.col("q"), F.col("t"), F.lit(False))
    return rows.select("query_id", "best", (F.col("best").isNull() | (F.col("best") < 0.25)).alias("abstain"), retry.alias("retry"), F.array_join(lookup.why(F.col("q"), F.col("t")), " ").alias("why"))


_ALIAS_ROWS = ", ".join(f"({i}, '{k}', {[k, *v]!r})" for i, (k, v) in enumerate(lookup.ALIASES.items()))
_ALIASES = f"a(i, k, forms) AS (VALUES {_ALIAS_ROWS})"
_FORMS = [x for k, v in lookup.ALIASES.items() for x in (k, *v)]


def _asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each part: its name, with an abbreviation or a synonym for most."""
    forms = F.array(*map(F.lit, _FORMS))
    pick = F.get(forms, (F.col("p_partkey") % (len(_FORMS) + 3)).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", pick, F.lit("process")).alias("text"))


_ASKS = f"q AS (SELECT p_partkey AS query_id, concat_ws(' ', p_name, {_FORMS!r}[p_partkey % {len(_FORMS) + 3} + 1], 'process') AS text FROM part)"


@query(
    f"""WITH {_ALIASES}, {_ASKS},
m AS (SELECT query_id, i, forms FROM q LEFT JOIN a ON len(list_filter(forms, lambda f: contains(' ' || regexp_replace(lower(text), '[^a-z0-9&]+', ' ', 'g') || ' ', ' ' || lower(f) || ' '))) > 0)
SELECT query_id, coalesce(string_agg(array_to_string(forms, '|'), '|' ORDER BY i), '') AS phrases FROM m GROUP BY query_id"""
)
def alias_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asks(spark, sf_dir).select("query_id", F.array_join(lookup.expanded_aliases(F.col("text")), "|").alias("phrases"))


@query(
    """WITH b AS (SELECT DISTINCT p_type || p_size AS bucket, p_name AS alias FROM part), s AS (SELECT DISTINCT p_name AS seed FROM part WHERE p_partkey % 50 = 0)
SELECT DISTINCT b.alias AS seed, t.alias AS alias FROM b JOIN s ON s.seed = b.alias JOIN b t ON b.bucket = t.bucket AND lower(b.alias) <> lower(t.alias)"""
)
def hint_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts of one type and size as aliases of each other; asked for the parts whose key 50 divides."""
    parts = table(spark, sf_dir, "part")
    buckets = parts.select(F.concat("p_type", F.col("p_size").cast("string")).alias("bucket"), F.col("p_name").alias("alias")).distinct()
    seeds = parts.where("p_partkey % 50 = 0").select(F.col("p_name").alias("seed")).distinct()
    return lookup.hints(buckets, seeds)


_GOLD = "gold AS (SELECT q.vec_id AS query_id, d.vec_id AS item, 1.0 AS gain FROM embeddings q JOIN embeddings d ON q.label = d.label AND q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)"


@query(
    f"""WITH ranked AS ({_KNN.format("list_cosine_similarity(q, v)", _Q50)}), {_GOLD},
h AS (SELECT gold.query_id, count(*) AS expected, count(rank) AS found, coalesce(sum(gain / log2(rank + 1)), 0) AS dcg, min(rank) AS first FROM gold LEFT JOIN ranked ON gold.query_id = ranked.query_id AND item = vec_id GROUP BY 1),
i AS (SELECT query_id, sum(gain / log2(k + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, item) AS k FROM gold) GROUP BY 1)
SELECT query_id, round(found / expected, 6) AS recall, round(dcg / idcg, 6) AS ndcg, round(coalesce(1.0 / first, 0), 6) AS mrr FROM h JOIN i USING (query_id)"""
)
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the query's label are relevant; ranked by cosine."""
    from ..operators import corpus

    vectors = table(spark, sf_dir, "embeddings")
    ranked = retrieval.knn(vectors.where("vec_id % 50 = 0"), vectors, 10).withColumnRenamed("vec_id", "item")
    return corpus.label_metrics(ranked, vectors.select(F.col("vec_id").alias("item"), "label"), vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id")))
