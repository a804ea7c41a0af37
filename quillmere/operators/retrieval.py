"""Lexical, sparse, dense and fused retrieval over tables of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..sources import store


def top_k(rows: DataFrame, k: int, key: str, score: str, item: str) -> DataFrame:
    """The k best rows a key, score rounded first, ties by the item; with their rank.
    Spark cuts each task's rows to k before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(key).orderBy(F.desc(score), item)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return queries.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(text.index_tokens(F.col(text_col)))).alias("term"))


def sparse_weights(rows: DataFrame, id_col: str, text_col: str, top: int | None = None) -> DataFrame:
    """(id, term, weight): log1p(tf) over the number of tokens; optionally the top terms of each row."""
    tokens = rows.select(F.col(id_col), text.sparse_tokens(F.col(text_col)).alias("w"))
    out = tokens.select(id_col, F.size("w").alias("total"), F.explode("w").alias("term")).groupBy(id_col, "total", "term").agg(F.count("*").alias("tf"))
    out = out.select(id_col, "term", F.round(F.log1p("tf") / F.col("total"), 9).alias("weight"))
    return top_k(out, top, id_col, "weight", "term").drop("rank") if top else out


def sparse_dot(queries: DataFrame, corpus: DataFrame, query_id: str, doc_id: str) -> DataFrame:
    q = queries.select(F.col(query_id).alias("query_id"), "term", F.col("weight").alias("qw"))
    d = corpus.select(F.col(doc_id).alias("chunk_id"), "term", F.col("weight").alias("dw"))
    return q.join(d, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("qw") * F.col("dw")), 6).alias("score"))


def l2_normalised(vector: Column) -> Column:
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(wide, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


#: Vector values of a corpus slice that is held at a time.
SLICE_VALUES = 1 << 22


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls as one matrix; lists of different lengths raise an error."""
    rows = len(lists)
    sizes = np.unique(np.asarray(lists.value_lengths()))
    if len(sizes) > 1:
        raise ValueError(f"vectors of different sizes: {sizes[:5].tolist()}")
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(rows, -1)


def _blocks(path: str, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a Parquet folder, at most ``rows`` at a time, read by the task itself."""
    for batch in store.batches(path, rows):
        yield np.asarray(batch.column(0)), _matrix(batch.column(1))


def knn(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding", block: int = 2048, same: bool = False) -> DataFrame:
    """(query_id, vec_id, score, rank): exact top k for each query row. cosine and dot: higher is better;
    euclid: score is the negative distance. Rows with a null vector or id take no part.

    One pass over the corpus, however many queries: they are written to the shared folder, and each task takes them
    ``block`` rows at a time against slices of its own vectors, as matrix products. It keeps k rows a query and slice;
    one window merges what the tasks found."""
    if metric not in ("cosine", "dot", "euclid"):
        raise ValueError(metric)
    use = lambda df: df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    path = store.new_path(corpus.sparkSession, "queries")
    use(queries).write.parquet(path)
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) if metric == "cosine" else v

    def best(vec_id: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        v = unit(v)
        for ids, q in _blocks(path, block):
            q = unit(q)
            score = q @ v.T
            if metric == "euclid":
                score = -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * score, 0))
            score = np.round(score, 6)
            if not same:
                score[ids[:, None] == vec_id[None, :]] = -np.inf
            n = min(k, len(vec_id))
            # ties at the edge are kept whole, so that the id decides
            edge = -np.partition(-score, n - 1, axis=1)[:, n - 1]
            row, col = np.nonzero((score >= edge[:, None]) & (score > -np.inf))
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(vec_id[col]), pa.array(score[row, col])], ["query_id", "vec_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, values = [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, block):
                part = batch.slice(low, block)
                held.append((np.asarray(part.column(0)), _matrix(part.column(1))))
                values += held[-1][1].size
                if values >= SLICE_VALUES:
                    yield from best(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, values = [], 0
        if held:
            yield from best(*(np.concatenate(x) for x in zip(*held, strict=True)))

    out = use(corpus).mapInArrow(search, "query_id long, vec_id long, score double")
    return top_k(out, k, "query_id", "score", "vec_id")


def rrf(*lists: DataFrame, key: str = "query_id", item: str = "item", k: int = scoring.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (key, item, rank): (key, item, rrf, each list's rank, rank), the rank by
    rrf, ties by the lists' ranks in the order given (a missing one last)."""
    parts = [x.select(key, item, F.col("rank"), F.lit(i).alias("list")) for i, x in enumerate(lists)]
    both = parts[0]
    for x in parts[1:]:
        both = both.unionByName(x)
    ranks = [F.min(F.when(F.col("list") == i, F.col("rank"))).cast("long").alias(f"rank_{i}") for i in range(len(lists))]
    out = both.groupBy(key, item).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf"), *ranks)
    w = Window.partitionBy(key).orderBy(F.desc("rrf"), *[F.asc_nulls_last(f"rank_{i}") for i in range(len(lists))], item)
    return out.withColumn("rank", F.row_number().over(w).cast("long"))


def max_sim(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Late interaction over token vectors (id, token, vector): (query_id, chunk_id, score), the sum over a query's
    tokens of their best dot product with a token of the chunk, every query against every chunk.

    queries is a bounded set of token vectors: it is written once, and each task holds it whole beside one chunk's tokens
    at a time. Null vectors take no part."""
    path = store.new_path(docs.sparkSession, "tokens")
    queries.where("vector is not null and id is not null").select(F.col("id").cast("long").alias("id"), "vector").write.parquet(path)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(_blocks(path, 1 << 16))
        if not parts:
            return
        q_ids, q = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(q_ids, kind="stable")
        q_ids, q = q_ids[order], q[order]
        heads = np.flatnonzero(np.append(True, q_ids[1:] != q_ids[:-1]))
        for batch in batches:
            for chunk, vectors in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                best = (q @ _matrix(vectors.values).T).max(axis=1)  # each query token's best dot product in the chunk
                total = np.round(np.add.reduceat(best, heads), 6)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[heads]), pa.array([chunk] * len(heads), pa.int64()), pa.array(total)], ["query_id", "chunk_id", "score"])

    grouped = docs.where("vector is not null").groupBy(F.col("id").cast("long").alias("chunk_id")).agg(F.collect_list("vector").alias("vectors"))
    return grouped.mapInArrow(score, "query_id long, chunk_id long, score double")
