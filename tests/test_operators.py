"""Operators on small tables with answers worked out by hand."""

import math
import re
import sqlite3
import uuid

import pytest
from pyspark.sql import functions as F

from quillmere.functions import scoring, text
from quillmere.operators import chunking, corpus, graph, lookup, retrieval
from quillmere.operators.index import LexicalIndex


def test_bm25_equals_fts5(spark, tmp_path):
    docs = [(1, "the cat sat on the mat"), (2, "a cat and a dog"), (3, "dogs run far"), (4, "the the the end"), (5, None), (6, "")]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize=\"unicode61 remove_diacritics 2\")")
    db.executemany("insert into t(rowid, x) values (?, ?)", [d for d in docs if d[1]])
    want = {r: round(-s, 6) for r, s in db.execute("select rowid, bm25(t) from t where t match 'cat OR the OR dog'")}
    df = spark.createDataFrame(docs, "id long, text string")
    terms = spark.createDataFrame([(0, t) for t in ("cat", "the", "dog")], "query_id int, term string")
    got = LexicalIndex.build(df, f"file://{tmp_path}/index", "id").any_term(terms).collect()
    assert {r["chunk_id"]: r["bm25"] for r in got} == want


def test_rrf_ranks_and_sums(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, item string, rank int")
    b = spark.createDataFrame([(1, "y", 1)], "query_id int, item string, rank int")
    got = {r["item"]: (r["rrf"], r["rank_0"], r["rank_1"]) for r in retrieval.rrf(a, b).collect()}
    assert got == {"x": (round(1 / 61, 9), 1, None), "y": (round(1 / 62 + 1 / 61, 9), 2, 1)}


def test_knn_blocks_and_ties(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(12)] + [(99, None)], "vec_id long, embedding array<float>")
    whole = retrieval.knn(v, v, 3).orderBy("query_id", "rank").collect()
    assert retrieval.knn(v, v, 3, block=2).orderBy("query_id", "rank").collect() == whole
    assert [r["vec_id"] for r in whole if r["query_id"] == 0] == [3, 6, 9]


def test_decay_prior_and_fold(spark):
    row = spark.range(1).select(
        scoring.decay(F.lit(180.0)).alias("d"), scoring.decay(F.lit(None).cast("double")).alias("n"), scoring.prior(F.lit(-5.0)).alias("p"), scoring.folded_prior(F.array(*map(F.lit, [-2.0, 0.5, 9.0]))).alias("f")
    ).first()
    assert (row["d"], row["n"], row["p"], row["f"]) == pytest.approx((0.925, 1.0, 0.1, 4.0))


def test_uuid5(spark):
    ns = uuid.uuid4()
    got = spark.range(1).select(text.uuid5(F.lit(str(ns)), F.lit("ä-1")).alias("u")).first()["u"]
    assert got == str(uuid.uuid5(ns, "ä-1"))


@pytest.mark.parametrize(("query", "route"), [("pump", "sparse"), ("pump station DAF seal", "hybrid"), ("what is it?", "rerank"), ("one two three four five", "hybrid"), (" ".join("abcdefghijkl"), "rerank")])
def test_route(spark, query, route):
    assert spark.range(1).select(scoring.route(F.lit(query)).alias("r")).first()["r"]["route"] == route


def test_acl_order_of_rules(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "doc_id int, collection string")
    acl = spark.createDataFrame([("document", "1", [], ["*"]), ("document", "2", ["u"], []), ("collection", "a", ["x"], []), ("collection", "b", [], ["u"]), ("default", "*", ["x"], [])], "level string, key string, allow array<string>, deny array<string>")
    assert {r["doc_id"]: r["allowed"] for r in lookup.allowed(rows, acl, ["u"]).collect()} == {1: False, 2: True, 3: False, 4: False}


def test_neighbours_between_chunks(spark):
    chunks = spark.createDataFrame([(1, s, f"t{s}", s + 5) for s in (0, 10, 20, 30)], "doc_id int, chunk_start int, text string, chunk_end int")
    at = spark.createDataFrame([(1, 15)], "doc_id int, chunk_start int")
    assert sorted(r["chunk_start"] for r in lookup.neighbours(chunks, at, 1).collect()) == [10, 20, 30]
    assert lookup.context(chunks).orderBy("chunk_start").first()["context_text"] == "t0\nt10"


def test_fold_blocks_overlap():
    para = lambda t: {"kind": "para", "text": t, "section_path": []}
    head = {"kind": "heading", "text": "H", "section_path": ["H"]}
    rows = [para("One. Two."), para("x" * 20), head, para("End.")]
    assert [c["text"] for c in chunking.fold_blocks(rows, max_chars=20)] == ["One. Two.\n\n" + "x" * 20, "H", "End."]
    assert len(chunking.fold_blocks(rows, max_chars=20, compat=True)) > 3
    assert chunking.fold_blocks([], max_chars=20) == []


def test_windows_match_a_loop(spark):
    docs = [(1, "abcdefghij" * 3), (2, ""), (3, None), (4, "   "), (5, "abc")]
    got = sorted((r["doc_id"], r["chunk_start"], r["text"]) for r in chunking.windows(spark.createDataFrame(docs, "doc_id int, text string"), size=10, overlap=3).collect())
    want = []
    for i, t in docs:
        at = 0
        while t and at < len(t):
            if t[at : at + 10].strip():
                want.append((i, at, t[at : at + 10]))
            if at + 10 >= len(t):
                break
            at += 7
    assert got == sorted(want)


def test_upper_entities_match_python(spark):
    texts = [(1, "The DAF UNIT2 and ÉABC and MLSS, mlss MLSS"), (2, None)]
    got = [r["label"] for r in graph.upper_entities(spark.createDataFrame(texts, "doc_id int, text string")).collect()]
    assert sorted(got) == sorted({m for m in re.findall(r"\b[A-Z]{3,}(?:\s+[A-Z0-9]{2,})*\b", texts[0][1]) if len(m) >= 4})


def test_prune_drops_unused(spark):
    nodes = spark.createDataFrame([("d", "doc", "doc"), ("e", "Tank", "entity"), ("j", "12345", "entity"), ("s", "S", "section")], "id string, label string, type string")
    edges = spark.createDataFrame([("d", "e", "mentions", "d"), ("d", "e", "mentions", "d"), ("d", "j", "mentions", "d"), ("e", "j", "co_occurs", "d")], "src string, dst string, type string, doc_id string")
    left, kept = graph.pruned(nodes, edges, 100)
    assert {r["id"] for r in left.collect()} == {"d", "e"} and kept.count() == 1


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 3)], "query_id int, item string, rank int")
    gold = spark.createDataFrame([(1, "b", 2.0), (1, "z", 1.0), (2, "a", 1.0)], "query_id int, item string, gain double")
    got = {r["query_id"]: (r["recall"], r["ndcg"], r["mrr"]) for r in corpus.ranking_metrics(ranked, gold).collect()}
    ideal = 2 / math.log2(2) + 1 / math.log2(3)
    assert got == {1: (0.5, round(2 / 2 / ideal, 6), round(1 / 3, 6)), 2: (0.0, 0.0, 0.0)}


def test_upsert_twice_is_the_same(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, text string")
    new = spark.createDataFrame([(2, 2, "c"), (2, 3, "d"), (3, 1, " ")], "k int, v int, text string")
    once = corpus.upserted(old, new, "k", "v")
    twice = corpus.upserted(once, new, "k", "v")
    assert sorted(once.collect()) == sorted(twice.collect()) == [(1, 1, "a"), (2, 3, "d")]


def test_scan_filters(spark, tmp_path):
    from quillmere.sources import files

    for name in ("a.txt", "b.pdf", "c.exe", "skip/x.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("hello")
    found = files.scan(spark, str(tmp_path), skip=("*/skip/*",)).collect()
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in found) == ["a.txt", "b.pdf"]


def test_hit_coverage_measures_each_items_best_hits(spark, tmp_path):
    """Items of any id meet the documents that their words find, and no others."""
    from quillmere.plans import corpus as plans

    docs = [(1, "red fox den"), (2, "blue whale sea"), (3, "red fox and hound"), (45, "green tea"), (46, "filler words here"), (47, "more filler")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, "blue whale krill"), (45, "red fox hound"), (199, "green tea leaves cup"), (200, "nowhere")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r["item_id"], r["doc_id"]): r["coverage"] for r in plans.hit_coverage(spark, str(tmp_path)).collect()}
    assert got == {(1, 2): 0.6667, (45, 1): 0.6667, (45, 3): 1.0, (199, 45): 0.5}


def test_neighbors_has_every_chunk_as_anchor(spark, tmp_path):
    from quillmere.plans import corpus as plans

    docs = [(1, "word " * 900), (2, "short"), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    starts = list(range(0, 4500, 750))
    want = {(1, a, b) for i, a in enumerate(starts) for b in starts[max(0, i - 2) : i + 3]} | {(2, 0, 0)}
    got = [tuple(r) for r in plans.neighbors(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want
