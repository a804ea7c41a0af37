"""Layouts, chunk folds, keyphrases, pruning and the ingest chain against brute force."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmere.operators import chunking, corpus, graph, graph_build, ingest, layout
from quillmere.sources import files
from quillmere.streaming import ingest as streaming

TEXT = "# Top\n\nOne is here. Two is there.\n\n- a\n- b\n\n## Sub\n\n| h (cm) | k |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n\nLast words. And more."


def test_chunk_fold_keeps_the_whole_record():
    rows = [
        {"kind": "heading", "text": "H", "section_path": ["H"], "page": 1, "element_id": "h1", "bbox": [0, 0, 1, 1], "source_tool": "x"},
        {"kind": "para", "text": "A one. B two.", "section_path": ["H"], "page": 1, "element_id": "p1", "bbox": None, "source_tool": "x"},
        {"kind": "table_row", "text": "h: 1", "section_path": ["H"], "page": 2, "element_id": "t1", "headers": ["h (cm)"], "units": {"h": "cm"}, "source_tool": "y"},
        {"kind": "para", "text": "", "section_path": None},
    ]
    got = chunking.fold_blocks(rows, max_chars=5)
    assert [c["text"] for c in got] == ["H", "A one. B two.", "B two.\n\nh: 1"]
    assert got[2]["types"] == ["para", "table_row"] and got[2]["pages"] == [1, 2] and got[2]["element_ids"] == ["t1"] and got[2]["units"] == ["cm"] and got[2]["headers"] == ["h (cm)"] and got[2]["source_tools"] == ["x", "y"]
    assert [(c["chunk_start"], c["chunk_end"]) for c in got] == [(0, 1), (1, 14), (14, 26)]
    rows_alone = chunking.fold_blocks(rows, max_chars=5, profile_name="table_row")
    assert [c["text"] for c in rows_alone] == ["H", "A one. B two.", "h: 1"]
    assert "B two." in [c["text"] for c in chunking.fold_blocks(rows[:2], max_chars=5, compat=True)]
    with pytest.raises(ValueError):
        chunking.fold_blocks(rows, max_chars=0)


def test_text_chunks(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, ""), (3, None)], "doc_id long, text string")
    got = [tuple(r)[1:] for r in layout.text_chunks(docs, 40, 10).orderBy("doc_id", "chunk").collect()]
    assert [x[3] for x in got][-3:] == ["h (cm): 1; k: 2", "h (cm): 3; k: 4", "Last words. And more."] and got[0][3].startswith("One is here. Two is there.")
    assert got[0][5] == ["Top"] and got[-1][5] == ["Top", "Sub"] and TEXT[got[-1][1] : got[-1][2]].endswith("And more.")


def test_texts_fold_where_they_are(spark):
    """The folds of texts, without an exchange, equal those of the block tables."""
    rng = random.Random(2)
    lines = ["", " ", "\t", "# Top", "## Sub \r", "#\u2003x", "1.2 Number", "12 x. Y!", "1 \u0085", "- a", "2) b", "+ c ", "| a | b |", "|---|:-:|", "| 1 | 2 |\r", "a|b|c", "x\ty", "One is. Two? Three", "é \u2028 z", "٣ x", "####### no", "-"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 30))) for _ in range(300)] + ["", None, "\n", TEXT]
    docs = spark.createDataFrame([(i, "/x", t) for i, t in enumerate(texts)], "doc_id long, path string, text string").repartition(3)
    tables = chunking.blocks(docs).withColumn("rows", F.when(F.col("kind") == "table", chunking.table_rows(F.col("lines"))))
    by = {}
    for r in tables.orderBy("doc_id", "block").collect():
        by.setdefault(r["doc_id"], []).append({k: r[k] for k in ("lines", "start", "end", "kind", "level", "rows")})
    for i, t in enumerate(texts):
        assert chunking.text_blocks(t or "") == by.get(i, []), repr(t)
    made = ingest.ingested(docs, max_chars=40)
    want = chunking.structured_chunks(made["blocks"].join(chunking.profiles(docs, made["blocks"]), "doc_id"), max_chars=40)
    got = made["chunks"].drop("chunk_id").select(want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    plain = layout.text_chunks(docs, 40, 10)
    assert sorted((r["doc_id"], r["chunk"], r["text"]) for r in plain.collect()) == sorted((i, k, x["text"]) for i, b in by.items() for k, x in enumerate(layout.fold_text(b, 40, 10)))
    for x in (plain, made["chunks"]):
        plan = x._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroups" not in plan and "Window" not in plan and "Join" not in plan


def test_ingested_chain(spark):
    long = "The PUMP STATION feeds the tank. Flow rate: 12 m3/h. " + " ".join(f"word{i} filter" for i in range(40))
    docs = spark.createDataFrame([(1, "/a", TEXT), (2, "/b", long), (3, "/c", ""), (4, "/d", None)], "doc_id long, path string, text string")
    made = ingest.ingested(docs)
    chunks = made["chunks"].collect()
    assert {c["doc_id"] for c in chunks} == {1, 2} and len({c["chunk_id"] for c in chunks}) == len(chunks)
    assert all(re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", c["chunk_id"]) for c in chunks)
    nodes = {r["id"]: (r["label"], r["type"]) for r in made["nodes"].collect()}
    assert nodes["entity::pump-station"] == ("PUMP STATION", "entity") and nodes["entity::flow-rate"][1] == "parameter" and nodes["doc::3"] == ("/c", "doc")
    edges = {(r["src"], r["dst"], r["type"]) for r in made["edges"].collect()}
    assert any(t == "has_measurement" for _, _, t in edges) and len(edges) == made["edges"].count()
    seen = docs.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    assert {r["doc_id"] for r in ingest.ingested(docs, seen.where("doc_id = 2"))["metadata"].collect()} == {1, 3, 4}
    assert made["summaries"].where("doc_id = 1").count() > 1 and made["blocks"].where("doc_id = 1 and kind = 'table'").count() == 1


def test_keyphrases_brute_force(spark):
    texts = ["alpha beta gamma delta " * 8, "alpha pumps water " * 10 + "omega", "short text"] + [f"alpha filler{i} text{i} " * 12 for i in range(6)]
    chunks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, chunk_start long, text string")
    got = {}
    for r in graph_build.keyphrases(chunks).collect():
        got.setdefault(r["doc_id"], {})[r["pos"]] = r["label"]
    some = {i: re.findall(r"[^\W\d_][\w-]{2,}", t.lower()) for i, t in enumerate(texts) if len(t.strip()) >= 120 and len(t.split()) >= 25}
    stop = set(corpus.STOPWORDS) | set(graph_build.STOP_LABELS)
    each = {i: [x for x in w + [" ".join(p) for p in zip(w, w[1:])] if not set(x.split()) & stop and len(x) >= 4] for i, w in some.items()}
    df = Counter(x for w in each.values() for x in set(w))
    for i, w in each.items():
        tf, first = Counter(w), {x: k for k, x in reversed(list(enumerate(some[i] + [" ".join(p) for p in zip(some[i], some[i][1:])])))}
        ok = [x for x in tf if df[x] <= max(1, len(some) * 0.5)]
        want = sorted(ok, key=lambda x: (-round(tf[x] * math.log((len(some) + 1) / df[x]), 9), first[x], x))[: 3 if len(texts[i].strip()) <= 800 else 5]
        assert [got[i][k] for k in sorted(got[i])] == want


def test_keyphrase_bounds_change_nothing_but_rows(spark, monkeypatch):
    from quillmere.operators import phrases

    monkeypatch.setattr(phrases, "CHARS", 20_000)
    rng = random.Random(11)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i % 7}" for i in range(400)]
    texts = [" ".join(words[min(399, int(rng.expovariate(0.02)))] for _ in range(rng.choice([20, 40, 200]))) for _ in range(120)] + ["été-x ²³ " * 40, "İstanbul ΣΟΦΟΣ " * 30]
    chunks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, chunk_start int, text string").repartition(3)
    bounds = graph_build.phrase_bounds(chunks)
    cut = graph_build.keyphrases(chunks, bounds=bounds)
    whole = sorted(tuple(r) for r in graph_build.keyphrases(chunks).collect())
    assert sorted(tuple(r) for r in cut.collect()) == whole and len(whole) > 300
    rows = lambda b: sum(x.num_rows for x in phrases.counted(iter(chunks.coalesce(1).toArrow().to_batches()), b, 0.5))
    assert rows(bounds) < rows(None) / 2  # what is dealt out by phrase
    assert cut._jdf.queryExecution().executedPlan().toString().count("Generate") == 0  # no row a word before it is counted in its chunk


def test_prune(spark):
    nodes = [("doc::1", "/a", "doc"), ("entity::good", "good pump", "entity"), ("entity::page-1", "page 1", "entity"), ("entity::kept", "12345", "entity"), ("alone", "x", "section"), ("c1", "e1", "para")]
    edges = [("c1", "entity::good", "mentions", 1), ("c1", "entity::good", "mentions", 1), ("c1", "entity::page-1", "mentions", 1), ("c1", "entity::kept", "row_has_parameter", 1), ("entity::good", "entity::kept", "co_occurs", 1)]
    left, kept = graph.pruned(spark.createDataFrame(nodes, "id string, label string, type string"), spark.createDataFrame(edges, "src string, dst string, type string, doc_id long"), percent=100)
    assert {r["id"] for r in left.collect()} == {"doc::1", "entity::good", "entity::kept", "c1"}
    assert sorted((r["dst"], r["type"]) for r in kept.collect()) == [("entity::good", "mentions"), ("entity::kept", "row_has_parameter")]


def test_graph_of_a_small_file_is_dealt_out(spark):
    rows = spark.createDataFrame([(i, 0, f"The PUMP UNIT {i} feeds the tank. Flow rate: {i} m3/h") for i in range(64)], "doc_id long, chunk_start int, text string").coalesce(1)
    none = F.array().cast("array<string>")
    chunks = rows.select("*", F.array(F.lit("s")).alias("section_path"), F.array(F.lit("e1")).alias("element_ids"), F.array(F.lit("para")).alias("types"), none.alias("headers"))
    docs = rows.select("doc_id", F.lit("/p").alias("path"), none.alias("concepts"), F.array(F.lit("kg")).alias("units"))
    nodes, edges = graph_build.built(chunks, docs)
    plan = nodes.select("id", "label", "type")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "RepartitionByExpression" in plan
    assert nodes.where("id = 'entity::kg'").first()["doc_ids"] == list(range(64)) and edges.where("type = 'has_measurement'").count() == 64


def test_co_occurrence_bound(spark):
    rows = spark.createDataFrame([(1, f"e{i}") for i in range(5)], "chunk long, entity string")
    assert graph_build.co_occurrences(rows).count() == 10
    with pytest.raises(Exception, match="max_per_chunk"):
        graph_build.co_occurrences(rows, 4).collect()


def test_guards(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id long, embedding array<double>")
    with pytest.raises(Exception, match="another size"):
        ingest.checked_vectors(rows, 2, "cosine").collect()
    assert ingest.checked_vectors(rows.where("id <> 2"), 2, "dot").count() == 2
    with pytest.raises(ValueError):
        ingest.checked_vectors(rows, 2, "cosine", {"size": 3, "metric": "cosine"})
    old = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k long, v long, text string")
    new = spark.createDataFrame([(1, 7, "x"), (1, 7, "y"), (3, 1, " "), (1, 6, "z")], "k long, v long, text string")
    assert sorted(tuple(r) for r in corpus.upserted(old, new, "k", "v").collect()) == [(1, 7, "y"), (2, 5, "b")]
    assert sorted(r["v"] for r in corpus.upserted(old.drop("text"), new.drop("text"), "k", "v").collect()) == [1, 5, 7]
    assert ingest.deleted_where(old, k=1, v=5).count() == 1 and ingest.deleted_where(old).count() == 2
    assert ingest.breaches(spark.range(1).select(F.lit(1.0).alias("x"))).count() == 0


def test_catalog_and_files(spark, tmp_path):
    ingest.swapped(spark, "kb_now", spark.range(3))
    ingest.swapped(spark, "kb_now", spark.range(5))
    assert spark.table("kb_now").count() == 5 and ("kb_now", True) in ingest.collections(spark, "^kb_")
    assert ingest.dropped_collections(spark, "^kb_") == ["kb_now"] and ingest.collections(spark, "^kb_") == []
    at = f"file://{tmp_path}"
    files.write_json(spark.createDataFrame([(1, "x")], "a long, b string"), f"{at}/sub/json")
    assert files.read_json(spark, f"{at}/sub/json", "a long, b string").collect()[0]["b"] == "x"
    files.write_evaluation(spark.range(2), spark.range(1), f"{at}/sub/eval")
    assert {r["name"] for r in ingest.folder_sizes(spark, f"{at}/sub").collect()} == {"json", "eval"}
    files.append_audit(spark.createDataFrame([("e", "user:a")], "event string, subject string"), f"{at}/audit", "subject")
    assert spark.read.json(f"{at}/audit").first()["subject"] != "user:a"
    deep = tmp_path / "a.b" / "x" / "y"
    deep.mkdir(parents=True)
    for p in (tmp_path / "a.b" / "1.txt", deep / "2.TXT", deep / "3.md"):
        p.write_text("t")
    found = [r["path"].rsplit("/", 1)[1] for r in files.corpus_scan(spark, f"{at}/a.b").collect()]
    assert found == ["1.txt", "2.TXT"] and files.scan(spark, f"{at}/a.b", limit=1).count() == 1 and files.scan(spark, f"{at}/a.b", max_depth=1).count() == 1
    assert files.read_jsonl(spark, f"{at}/sub/json", "a long").count() == 1


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", "a", float(m)) for m in range(3)], "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    seen = []
    streaming.upsert_stream(stream, lambda df: seen.append(df.count()), f"{tmp_path}/check").awaitTermination()
    assert sum(seen) == 3
    assert streaming.event_counts(rows).first()["n"] == 3


def test_units_and_sections(spark):
    got = graph.measurements(spark.createDataFrame([(1, "Flow rate: 12.5 m3/h, Pressure = 4 bar; Flow rate: 13 m3/h")], "doc_id int, text string")).collect()
    assert [(r["parameter"], r["value"], r["unit"]) for r in got] == [("Flow rate", "12.5", "m3/h"), ("Pressure", "4", "bar")]
    known = spark.createDataFrame([(3, "Tank"), (3, "Sump")], "doc_id int, label string")
    got = graph.relations(spark.createDataFrame([(3, "Tank drains to sump")], "doc_id int, text string"), known).collect()
    assert [tuple(r) for r in got] == [(3, "tank", "discharges_to", "sump")]
    heads = [(1, "A"), (2, "B"), (3, "C"), (2, "D"), (1, "E")]
    rows = spark.createDataFrame([(1, i, "heading", t, n) for i, (n, t) in enumerate(heads)], "doc_id long, block long, kind string, text string, level int")
    got = [" > ".join(r["section_path"]) for r in layout.with_paths(rows, level=F.col("level")).orderBy("block").collect()]
    assert got == ["A", "A > B", "A > B > C", "A > D", "E"]


def test_subjects_and_boosts():
    from quillmere.functions import text

    assert text.subjects() == ["user:anonymous", "*"]
    assert text.subjects({"id": "Ann", "email": "A@b", "roles": ["X"]}, ("x", "y"), "T") == ["user:ann", "email:a@b", "role:x", "role:y", "tenant:t", "*"]
    assert text.scope_boosts({"boost": {1: 2, "b": "bad"}, "demote": {1: -3, "c": "0.5"}}) == {"1": 0.0, "c": 0.5} and text.scope_boosts(None) == {}
