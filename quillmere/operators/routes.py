"""The retrieval routes over tables of queries: candidates in, ranked and scored rows out.

Candidates are (query_id, chunk_id, raw score, rank). attrs (chunk_id and any of age_days, delta, boost) carry what decay and
priors need; a chunk that attrs doesn't hold has neither. Without a reranker the rerank and hybrid routes
score as their fallbacks do. rank_by "raw" keeps the candidates' order, as multipliers don't re-sort there;
"final" orders by the multiplied score.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from . import lookup

#: The most candidates of a route, the scope of parameters, characters that a reranker reads.
MAX_CANDIDATES = 16
LIMITS = {"top_k": (1, 100), "retrieve_k": (1, 256)}
RERANK_CHARS, EMBED_CHARS = 900, 500
#: Hits that a table lookup looks through for each that it gives.
POOL = 3
MODES = ("auto", "colbert", "hybrid", "rerank", "semantic", "sparse", "sparse_splade")


def clamped(retrieve_k: int, return_k: int) -> tuple[int, int]:
    """retrieve_k within 1 to 256, return_k within 1 to retrieve_k."""
    retrieve_k = max(1, min(retrieve_k, 256))
    return retrieve_k, max(1, min(return_k, retrieve_k))


def multiplier(attrs: list[str]) -> Column:
    """decay * prior of a row that has been joined with attrs' columns."""
    has = lambda name: F.col(name) if name in attrs else F.lit(None).cast("double")
    return scoring.decay(has("age_days")) * scoring.prior(has("delta"), has("boost") if "boost" in attrs else None)


def _ranked(rows: DataFrame, score: str, rank_by: str, limit: int, route: str) -> DataFrame:
    """Rows with final_score, route and rank 1 to limit a query."""
    if rank_by not in ("raw", "final"):
        raise ValueError(rank_by)
    w = Window.partitionBy("query_id").orderBy(*([F.asc("rank")] if rank_by == "raw" else [F.desc(score), F.asc("rank")]), "chunk_id")
    out = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
    return out.withColumn("rank", F.col("_n").cast("long")).drop("_n").withColumns({"final_score": F.col(score), "route": F.lit(route)})


def _multiplied(rows: DataFrame, attrs: DataFrame, base: Column) -> DataFrame:
    names = [c for c in ("age_days", "delta", "boost") if c in attrs.columns]
    return rows.join(attrs.select("chunk_id", *names), "chunk_id", "left").withColumn("_s", F.round(base * multiplier(names), 9)).drop(*names)


def semantic(dense: DataFrame, attrs: DataFrame, top_k: int, return_k: int, rank_by: str = "raw") -> DataFrame:
    """dense (query_id, chunk_id, dense, rank) times prior and decay; the first max(top_k, return_k), cut to return_k."""
    rows = dense.where(F.col("rank") <= max(top_k, return_k))
    return _ranked(_multiplied(rows, attrs, F.col("dense")), "_s", rank_by, return_k, "semantic").drop("_s")


def sparse(lexical: DataFrame, attrs: DataFrame, retrieve_k: int, return_k: int, rank_by: str = "raw") -> DataFrame:
    """lexical (query_id, chunk_id, bm25, rank): bm25 normalised over a query's candidates, blended, times decay and prior."""
    rows = lexical.where(F.col("rank") <= min(retrieve_k, MAX_CANDIDATES)).withColumn("bm25_norm", F.round(scoring.min_max(F.col("bm25"), "query_id"), 6))
    return _ranked(_multiplied(rows, attrs, scoring.blend(bm25=F.col("bm25_norm"))), "_s", rank_by, return_k, "sparse").drop("_s")


def rerank(dense: DataFrame, attrs: DataFrame, retrieve_k: int, return_k: int, top_k: int, scores: DataFrame | None = None) -> DataFrame:
    """With scores (query_id, chunk_id, rerank) of the candidates: blended, times decay and prior, best first, return_k.
    Without, as when the reranker is down: dense * prior * decay in dense order, top_k."""
    rows = dense.where(F.col("rank") <= min(retrieve_k, MAX_CANDIDATES))
    if scores is None:
        return _ranked(_multiplied(rows, attrs, F.col("dense")), "_s", "raw", top_k, "rerank").drop("_s")
    rows = rows.join(scores.select("query_id", "chunk_id", "rerank"), ["query_id", "chunk_id"], "left")
    norms = {f"{s}_norm": F.round(scoring.min_max(F.col(s), "query_id"), 6) for s in ("dense", "rerank")}
    base = scoring.blend(dense=F.col("dense_norm"), rerank=F.col("rerank_norm"))
    return _ranked(_multiplied(rows.withColumns(norms), attrs, base), "_s", "final", return_k, "rerank").drop("_s")


def hybrid(fused: DataFrame, attrs: DataFrame, retrieve_k: int, return_k: int, top_k: int, scores: DataFrame | None = None) -> DataFrame:
    """fused (query_id, chunk_id, rrf, bm25, dense, rank) of lists of min(retrieve_k, 16) each, cut to as many.
    With scores: all three signals blended, best first, return_k; without: rrf * prior * decay in fused order, top_k."""
    rows = fused.where(F.col("rank") <= min(retrieve_k, MAX_CANDIDATES))
    if scores is None:
        return _ranked(_multiplied(rows, attrs, F.col("rrf")), "_s", "raw", top_k, "hybrid").drop("_s")
    rows = rows.join(scores.select("query_id", "chunk_id", "rerank"), ["query_id", "chunk_id"], "left")
    norms = {f"{s}_norm": F.round(scoring.min_max(F.col(s), "query_id"), 6) for s in ("bm25", "dense", "rerank")}
    base = scoring.blend(**{s: F.col(f"{s}_norm") for s in ("bm25", "dense", "rerank")})
    return _ranked(_multiplied(rows.withColumns(norms), attrs, base), "_s", "final", return_k, "hybrid").drop("_s")


def late(scored: DataFrame, attrs: DataFrame, retrieve_k: int, return_k: int) -> DataFrame:
    """Late-interaction scores (query_id, chunk_id, score, rank), min-max normalised over the first
    max(return_k, min(retrieve_k, 64)), weighted as dense, times decay and prior."""
    rows = scored.where(F.col("rank") <= max(return_k, min(retrieve_k, 64))).withColumn("norm", F.round(scoring.min_max(F.col("score"), "query_id"), 6))
    return _ranked(_multiplied(rows.drop("score"), attrs, scoring.blend(dense=F.col("norm"))), "_s", "raw", return_k, "colbert").drop("_s")


def dispatched(queries: DataFrame, routes: dict[str, Callable[[DataFrame], DataFrame]], route_col: str = "route") -> DataFrame:
    """Each route's rows for the queries that name it, united: one plan for a whole table of queries."""
    out = None
    for name in sorted(routes):
        found = routes[name](queries.where(F.col(route_col) == name))
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return out


def validated(queries: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """queries (query_id, text, mode, top_k, retrieve_k, return_k) with ``error``, null where all is well; the first
    fault of: empty text, unknown mode, top_k, retrieve_k, return_k out of their ranges."""
    bad = lambda name, high: F.col(name).isNull() | (F.col(name) < 1) | (F.col(name) > high)
    error = (
        F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty_query")
        .when(~F.coalesce(F.col("mode").isin(*modes), F.lit(False)), "invalid_mode")
        .when(bad("top_k", LIMITS["top_k"][1]), "invalid_top_k")
        .when(bad("retrieve_k", LIMITS["retrieve_k"][1]), "invalid_retrieve_k")
        .when(bad("return_k", F.col("retrieve_k")), "invalid_return_k")
    )
    return queries.withColumn("error", error)


def planned(queries: DataFrame, known: tuple[str, ...] = ("hybrid", "rerank", "semantic", "sparse")) -> DataFrame:
    """queries with route and k: the planner's for mode auto (rerank where it names none of known), else the mode itself and
    retrieve_k; k at least return_k, at most 256."""
    plan = scoring.route(F.col("text"))
    auto = F.col("mode") == "auto"
    route = F.when(auto, F.when(plan["route"].isin(*known), plan["route"]).otherwise("rerank")).otherwise(F.col("mode"))
    k = F.greatest(F.col("return_k"), F.least(F.when(auto, plan["k"]).otherwise(F.col("retrieve_k")), F.lit(256)))
    return queries.withColumns({"route": route, "k": k.cast("int")})


def best_scores(rows: DataFrame) -> DataFrame:
    """(query_id, best): the greatest score of a query's rows, at least 0; the first of final_score, score,
    rerank_score, rrf and dense that a row has counts. Forbidden rows don't."""
    names = [F.col(c).cast("double") for c in ("final_score", "score", "rerank_score", "rrf", "dense") if c in rows.columns]
    some = rows.where(~F.col("forbidden")) if "forbidden" in rows.columns else rows
    return some.groupBy("query_id").agg(F.greatest(F.lit(0.0), F.max(F.coalesce(*names, F.lit(0.0)))).alias("best"))


def unified(queries: DataFrame, routes: dict[str, Callable[[DataFrame], DataFrame]], texts: DataFrame, threshold: float = 0.0, fallback: str = "sparse") -> DataFrame:
    """The whole search over a table of queries (query_id, text, mode, top_k, retrieve_k, return_k): validation, plan, routes,
    abstention below threshold, a retry by the fallback route where the critic asks for it.

    Rows: query_id, kind (hit, abstain, error), route, rank, chunk_id, final_score, best, detail. A query has hits, or one
    abstain or error row, or none. texts (chunk_id, text) serve the critic, which looks at each query's first row.
    Each route is called with its queries (query_id, text, k, ...) and gives query_id, chunk_id, rank and final_score."""
    checked = planned(validated(queries))
    good = checked.where("error is null")
    columns = ["query_id", "chunk_id", "rank", "final_score", "route"]
    hits = dispatched(good, routes).select(*columns)
    best = good.select("query_id", "text", "route").join(best_scores(hits), "query_id", "left")
    first = hits.where("rank = 1").join(texts.select("chunk_id", F.col("text").alias("hit_text")), "chunk_id", "left").select("query_id", "hit_text", F.lit(True).alias("found"))
    best = best.join(first, "query_id", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    low = F.lit(threshold > 0) & (F.col("best") < threshold)
    tokens = F.filter(text.quality_tokens(F.col("text")), lambda t: F.length(t) >= 4)
    ask = F.coalesce(F.col("found"), F.lit(False)) & ~scoring.needs_retry(F.col("best"), tokens, F.col("hit_text"), F.lit(False))
    state = best.select("query_id", "text", "best", low.alias("abstains"), (~ask & (F.col("route") != fallback) & ~low).alias("retries"))
    again = good.drop("text").join(state.where("retries").select("query_id", "text"), "query_id").withColumn("k", F.greatest("k", F.lit(32)))
    second = routes[fallback](again).select(*columns[:-1], F.lit(fallback).alias("route"))
    answered = second.select("query_id").distinct().withColumn("answered", F.lit(True))
    state = state.join(answered, "query_id", "left").withColumn("retried", F.coalesce("answered", F.lit(False)))
    kept = hits.join(state.where("not abstains and not retried").select("query_id", "best"), "query_id")
    kept = kept.unionByName(second.join(best_scores(second), "query_id"))
    gone = state.where("abstains").select("query_id", F.lit("abstain").alias("kind"), "best", F.lit("low_answerability").alias("detail"))
    wrong = checked.where("error is not null").select("query_id", F.lit("error").alias("kind"), F.col("error").alias("detail"))
    out = kept.withColumn("kind", F.lit("hit")).unionByName(gone, allowMissingColumns=True).unionByName(wrong, allowMissingColumns=True)
    return out.select("query_id", "kind", "route", "rank", "chunk_id", "final_score", "best", "detail")


def hydrated(hits: DataFrame, chunks: DataFrame, key: str = "chunk_id", allowed: DataFrame | None = None) -> DataFrame:
    """hits with the chunk store's columns: those that a hit lacks, and values where its own are null or empty.
    allowed (doc_id, allowed): rows of documents that aren't keep their place, with no text, forbidden true and a reason."""
    other = [c for c in chunks.columns if c != key]
    out = hits.join(chunks.select(key, *[F.col(c).alias(f"_{c}") for c in other]), key, "left")
    kinds = dict(chunks.dtypes)
    for c in other:
        if c not in hits.columns:
            out = out.withColumn(c, F.col(f"_{c}"))
            continue
        own = F.col(c)
        if kinds[c] == "string":
            own = F.nullif(own, F.lit(""))
        elif kinds[c].startswith("array"):
            own = F.when(F.size(own) > 0, own)
        out = out.withColumn(c, F.coalesce(own, F.col(f"_{c}")))
    out = out.drop(*[f"_{c}" for c in other])
    if allowed is None:
        return out
    say = allowed.groupBy("doc_id").agg(F.min("allowed").alias("_may"))
    out = out.join(say, "doc_id", "left").withColumn("forbidden", ~F.coalesce("_may", F.lit(True))).drop("_may")
    return masked(out)


def masked(rows: DataFrame) -> DataFrame:
    """Rows whose forbidden is true without their text, and with a reason."""
    out = rows.withColumn("reason", F.when(F.col("forbidden"), "access_denied"))
    for c in ("text", "context_text"):
        if c in rows.columns:
            out = out.withColumn(c, F.when(~F.col("forbidden"), F.col(c)))
    return out


def table_units(queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """Units of a table lookup: each token of over two characters that is no stop word is a clause of its own; a
    query without any has all its terms in one clause."""
    from .corpus import TABLE_STOPWORDS

    rows = queries.select(F.col(id_col).alias("query_id"), text.index_tokens(F.col(text_col)).alias("w"))
    strong = F.array_distinct(F.filter("w", lambda t: (F.length(t) > 2) & ~t.isin(*TABLE_STOPWORDS)))
    rows = rows.withColumn("s", strong)
    some = rows.select("query_id", F.posexplode(F.when(F.size("s") > 0, F.col("s")).otherwise(F.col("w"))).alias("pos", "term"), (F.size("s") > 0).alias("strong"))
    return some.select("query_id", F.when(F.col("strong"), F.col("pos")).otherwise(0).cast("int").alias("clause"), F.array("term").alias("terms"))


def table_lookup(found: DataFrame, fallback: DataFrame, chunks: DataFrame, limit: int = 10, doc_id=None, where: dict[str, str] | None = None) -> DataFrame:
    """(query_id, chunk_id, bm25, rank) of table rows: of the first POOL * limit hits of found (query_id, chunk_id, bm25), or of
    fallback where a query has none, those whose chunk (chunk_id, doc_id, types, text) is a table row, is of doc_id
    where one is given and holds every key and value of where; at most limit, itself at most 50."""
    limit = max(1, min(limit, 50))
    from .retrieval import top_k

    rows = found.select("query_id", "chunk_id", "bm25").unionByName(fallback.join(found.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "chunk_id", "bm25"))
    rows = top_k(rows, POOL * limit, "query_id", "bm25", "chunk_id").drop("rank").join(chunks.select("chunk_id", "doc_id", "types", "text"), "chunk_id")
    rows = rows.where(lookup.is_table_row(F.col("types")) & lookup.where_filter(F.col("text"), where or {}))
    if doc_id is not None:
        rows = rows.where(F.col("doc_id") == doc_id)
    return top_k(rows, limit, "query_id", "bm25", "chunk_id").select("query_id", "chunk_id", "bm25", F.col("rank").cast("long").alias("rank"))


def canaries(queries: DataFrame, hits: DataFrame, limit: int = 6) -> DataFrame:
    """(collection, query_id, hits, passed) of each collection's first limit canary queries (collection, query_id, doc_id, min_hits):
    how many of a query's hits (query_id, doc_id) are of the document that it is to find."""
    w = Window.partitionBy("collection").orderBy("query_id")
    some = queries.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")
    met = some.join(hits.select("query_id", F.col("doc_id").alias("_doc")), "query_id", "left")
    met = met.groupBy("collection", "query_id", "min_hits").agg(F.count_if(F.col("_doc") == F.col("doc_id")).alias("hits"))
    return met.select("collection", "query_id", "hits", (F.col("hits") >= F.col("min_hits")).alias("passed"))


def hit_gate(hits: DataFrame, min_score: float = 0.0, require: tuple[str, ...] = (), require_table: bool = False) -> DataFrame:
    """One row a query with hits (query_id, rank, doc_id, score, coverage, types and the columns of require): hits, score and coverage
    summaries (averages rounded to 4), table_hits, duplicate_docs, failures, warnings, passed. coverage may be null, without query tokens.

    Failures name hits by rank - 1: a score below min_score, a required column without a value; and that no table row came. Warnings: the best coverage
    is under 0.3; a document comes twice. A query's hits are few, its failures a short array."""
    name = F.concat(F.lit("hit_"), (F.col("rank") - 1).cast("string"))
    score = F.coalesce("score", F.lit(0.0))
    bad = [F.when(score < min_score, F.concat(name, F.lit("_score_below_min"))), *[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.concat(name, F.lit(f"_missing_{c}"))) for c in require]]
    twice = hits.where("doc_id is not null").groupBy("query_id", "doc_id").agg(F.count("*").alias("n")).groupBy("query_id").agg(F.count_if(F.col("n") > 1).alias("duplicate_docs"))
    out = hits.groupBy("query_id").agg(
        F.count("*").alias("hits"),
        F.min(score).alias("score_min"),
        F.max(score).alias("score_max"),
        F.round(F.avg(score), 4).alias("score_avg"),
        F.max("coverage").alias("coverage_max"),
        F.round(F.avg("coverage"), 4).alias("coverage_avg"),
        F.count_if(lookup.is_table_row(F.col("types"))).alias("table_hits"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.array_compact(F.array(*bad)).alias("f")))), lambda x: x["f"])).alias("failures"),
    )
    out = out.join(twice, "query_id", "left").withColumn("duplicate_docs", F.coalesce("duplicate_docs", F.lit(0)))
    if require_table:
        out = out.withColumn("failures", F.when(F.col("table_hits") == 0, F.array_append("failures", F.lit("missing_table_hit"))).otherwise(F.col("failures")))
    warnings = F.array_compact(F.array(F.when(F.col("coverage_max") < 0.3, "low_query_coverage"), F.when(F.col("duplicate_docs") > 0, "duplicate_doc_hits")))
    return out.withColumns({"warnings": warnings, "passed": F.size("failures") == 0})
