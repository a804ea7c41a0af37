"""The lexical index against SQLite's FTS5, and routes, gates and matching against brute force."""

import math
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.functions import text
from quillmere.operators import corpus, index, lookup, retrieval, routes


def _fts5():
    try:
        con = sqlite3.connect(":memory:")
        con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61 remove_diacritics 2')")
        return con
    except sqlite3.OperationalError:
        return None


DOCS = [
    "Café flow-rate of the DAF unit", "dissolved air flotation and DAF pressure", "the café air, dissolved", "Ångström žluťoučký kůň ő ś", "air dissolved flotation dissolved air flotation",
    "pressure pressure pressure", None, "", "flow rate m3 and m³", "daf", "the the the of", "ÉTÉ été ete", "nothing to see here at all but words and words",
]


@pytest.mark.skipif(_fts5() is None, reason="SQLite without FTS5")
def test_index_equals_fts5(spark, tmp_path):
    con = _fts5()
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", [(i, t) for i, t in enumerate(DOCS) if t])
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    made = index.LexicalIndex.build(docs, f"file://{tmp_path}/index")
    cases = {
        "cafe": ("cafe", "all"), "daf pressure": ("daf pressure", "all"), "ete OR kun OR zlutoucky": ("ete kun zlutoucky", "any"), "the": ("The!", "all"), "angstrom o s": ("angstrom o s", "all"), "nosuchword": ("nosuchword", "all"),
    }
    for match, (query, mode) in cases.items():
        units = index.query_units(spark.createDataFrame([(1, query)], "query_id long, text string"), mode=mode)
        got = {r["chunk_id"]: r["bm25"] for r in made.search(units).collect()}
        want = dict(con.execute("SELECT rowid, -bm25(t) FROM t WHERE t MATCH ?", (match,)).fetchall())
        assert set(got) == set(want) and all(abs(got[i] - want[i]) < 2e-6 for i in got), match
    asked = spark.createDataFrame([(1, "daf pressure")], "query_id long, text string")
    got = {r["chunk_id"]: r["bm25"] for r in made.search(index.query_units(asked, aliases=True)).collect()}
    want = dict(con.execute("SELECT rowid, -bm25(t) FROM t WHERE t MATCH ?", ('daf pressure OR ("DAF" OR "dissolved air flotation")',)).fetchall())
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 2e-6 for i in got)
    none = index.LexicalIndex.build(docs.limit(0), f"file://{tmp_path}/none")
    assert none.search(index.query_units(asked)).count() == 0 and none.n_docs == 0


def test_best_of_many_queries(spark, tmp_path, monkeypatch):
    """The best k of each query equal the first k of all matches, and no task gives more than k rows a query of its own units."""
    from quillmere.operators import matching

    monkeypatch.setattr(matching, "CHUNKS", 16)
    monkeypatch.setattr(matching, "QUERIES", 3)
    monkeypatch.setattr(matching, "TOKENS", 300)
    monkeypatch.setattr(matching, "HELD", 10)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 5, 30])))) for i in range(150)]
    docs += [(1000 + i, docs[i][1]) for i in range(40)]  # copies: ties by the id
    asks = [(q, c, rng.sample(words, n)) for q in range(8) for c, n in enumerate(rng.choice([(1, 2), (2, 3), (1, 1, 1)]))]
    asks += [(q + 50, c, t) for q, c, t in asks if q < 4] + [(99, 0, ["w1"]), (99, 0, ["w2"]), (99, 1, ["w1", "w1"]), (98, 0, ["none"])]
    made = index.LexicalIndex.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), f"file://{tmp_path}/index")
    units = spark.createDataFrame(asks, "query_id int, clause int, terms array<string>")
    k = 4
    every = made.search(units)
    want = {tuple(r) for r in retrieval.top_k(every, k, "query_id", "bm25", "chunk_id").collect()}
    got = made.search(units, k)
    assert {tuple(r) for r in got.collect()} == want and got.schema["query_id"].dataType == units.schema["query_id"].dataType
    tokens = {i: t.split() for i, t in docs}
    clauses = {}
    for q, c, t in asks:
        clauses.setdefault((q, c), []).append(t)
    holds = lambda w, t: any(w[i : i + len(t)] == t for i in range(len(w)))
    assert {(r["query_id"], r["chunk_id"]) for r in every.collect()} == {(q, i) for (q, _), c in clauses.items() for i, w in tokens.items() if all(holds(w, t) for t in c)}
    given = []
    monkeypatch.setattr(matching, "_rows", lambda query, *rest: given.append(query) or iter(()))
    path = f"file://{tmp_path}/units"
    spark.createDataFrame([(1, 1, [(0, ["w1"])]), (2, 1, [(0, ["w1"])]), (3, 3, [(None, ["w1"]), (None, ["w2"])])], "query_id long, rep long, u array<struct<clause:int,terms:array<string>>>").write.parquet(path)
    matcher = matching.Matcher(path)
    list(matching.matches(matcher, iter(made.tokens().toArrow().to_batches()), k, np.ones(matcher.n_phrases), made.avgdl, 1.2, 0.75))
    assert sorted(x for q in given for x in q.tolist()) == [1] * k + [3] * k


def test_dense_routes_build_no_index(spark, monkeypatch):
    from quillmere.plans import routing, search

    def never(*_, **__):
        raise AssertionError("an index")

    monkeypatch.setattr(search, "index_of", never)
    assert routing.route_rerank(spark, "/root/testdata/sf0.001").count() > 0


def test_fold(spark):
    rows = spark.createDataFrame([("ŐŚžā É é",)], "t string").select(text.fold(F.col("t")).alias("t"))
    assert rows.first()["t"] == "osza e e"


def test_rrf_ties_by_dense_then_lexical_rank(spark):
    kinds = "query_id long, item long, rank long"
    dense = spark.createDataFrame([(1, 9, 1), (1, 5, 2)], kinds)
    lexical = spark.createDataFrame([(1, 3, 1), (1, 4, 2)], kinds)
    got = retrieval.rrf(dense, lexical).orderBy("rank").collect()
    assert [r["item"] for r in got] == [9, 3, 5, 4]


def test_max_sim_brute_force(spark):
    rng = random.Random(3)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    q = [(i, vec()) for i in (1, 1, 2)]
    d = [(i, vec()) for i in (7, 7, 7, 8, 9, 9)] + [(9, None)]
    kinds = "id long, vector array<double>"
    got = {(r[0], r[1]): r[2] for r in retrieval.max_sim(spark.createDataFrame(q, kinds), spark.createDataFrame(d, kinds)).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = {(i, c): round(sum(max(dot(v, w) for j, w in d if j == c and w) for k, v in q if k == i), 6) for i in (1, 2) for c in (7, 8, 9)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_knn_with_nulls_and_other_sizes(spark):
    kinds = "vec_id long, embedding array<float>"
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, None), (None, [1.0, 1.0])], kinds)
    got = [(r["query_id"], r["vec_id"]) for r in retrieval.knn(rows.where("vec_id = 1 or vec_id is null"), rows, 2).orderBy("rank").collect()]
    assert got == [(1, 2), (1, 3)]
    assert retrieval.knn(rows.limit(0), rows, 2).count() == 0
    with pytest.raises(Exception, match="different sizes"):
        retrieval.knn(rows.limit(1), rows.unionByName(spark.createDataFrame([(9, [1.0])], kinds)).coalesce(1), 2).collect()


def test_matched_relevance_brute_force(spark):
    rng = random.Random(5)
    rows = [(q, k + 1, rng.randrange(4), rng.choice(["the air", "of water", "none"])) for q in range(8) for k in range(6)]
    wants = [(q, n, rng.choice([None, 0, 1, 2]), rng.choice([None, "THE", "of"]), float(rng.randint(1, 3))) for q in range(8) for n in range(4)]
    got = corpus.matched_relevance(
        spark.createDataFrame(rows, "query_id long, rank long, doc_id long, text string"), spark.createDataFrame(wants, "query_id long, expectation long, doc_id long, contains string, gain double")
    ).collect()
    want = set()
    for q in range(8):
        seen = set()
        for _, rank, doc, said in (r for r in rows if r[0] == q):
            for _, n, d, c, g in (w for w in wants if w[0] == q):
                if n not in seen and (d is None or d == doc) and (c is None or c.lower() in said):
                    seen.add(n)
                    want.add((q, rank, n, g))
                    break
    assert {tuple(r) for r in got} == want


def test_gates_and_errors(spark):
    rows = spark.createDataFrame([(1, "x", "sparse", 10, 24, 8), (2, "", "sparse", 10, 24, 8), (3, "x", "no", 10, 24, 8), (4, "x", "sparse", 101, 24, 8), (5, "x", "sparse", 10, 300, 8), (6, "x", "sparse", 10, 4, 8), (7, None, "sparse", 1, 1, 1)], "query_id long, text string, mode string, top_k int, retrieve_k int, return_k int")
    got = {r["query_id"]: r["error"] for r in routes.validated(rows).collect()}
    assert got == {1: None, 2: "empty_query", 3: "invalid_mode", 4: "invalid_top_k", 5: "invalid_retrieve_k", 6: "invalid_return_k", 7: "empty_query"}
    assert routes.clamped(999, 999) == (256, 256) and routes.clamped(0, 5) == (1, 1)
    hit = spark.createDataFrame([(1, 1, 5, 0.5, None, ["para"])], "query_id long, rank long, doc_id long, score double, coverage double, types array<string>")
    got = routes.hit_gate(hit, 0.6, (), True).first()
    assert got["failures"] == ["hit_0_score_below_min", "missing_table_hit"] and not got["passed"] and got["warnings"] == []


def test_profiles_keep_markers(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.3, 0, True, "s"), (2, 0.7, 0.3, 86400, False, "t")], "doc_id long, final_score double, score double, mtime long, forbidden boolean, secret string")
    got = lookup.profiled(rows).collect()
    assert [(r["score"], r["mtime"], r["forbidden"]) for r in got] == [(0.3, None, True), (0.7, "1970-01-02T00:00:00Z", False)] and "secret" not in got[0].asDict()
    assert "secret" in lookup.profiled(rows, "diagnostic").columns and "final_score" in lookup.profiled(rows, "full").columns
    assert '"mtime"' not in lookup.as_records(lookup.profiled(rows)).first()["record"]


def test_blend_and_decay_formulas(spark):
    from quillmere.functions import scoring

    row = spark.range(1).select(scoring.decay(F.lit(180.0)).alias("d"), scoring.decay(F.lit(None).cast("double")).alias("n"), scoring.decay(F.lit(90.0), 180.0, 1.0).alias("f")).first()
    assert (round(row["d"], 9), row["n"], round(row["f"], 9)) == (0.925, 1.0, round(math.sqrt(0.5), 9))
