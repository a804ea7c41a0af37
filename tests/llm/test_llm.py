"""The training-data operators against brute force, and on nulls, empty texts, repeats and odd columns."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quillmere.llm import bitpack, common, compaction, components, decontaminate, html_mincut, jaccard_join, packing, quality_rules, token_counts, tokens, tool_links, toxicity

DOCS = "doc_id long, text string, `node` string, `set` int, n_words int"
ODD = [(1, None), (2, ""), (3, " \n "), (4, "one"), (4, "one"), (None, "one two three four"), (7, "a b c " * 40), (8, "word " * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", None, 3) for i, t in ODD], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_repeat_lengths_brute_force():
    rng = random.Random(1)
    for _ in range(100):
        docs = [[rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(18))] for _ in range(3)]
        codes, rows = np.array(sum(docs, []), np.int64), np.repeat(np.arange(3), [len(d) for d in docs])
        want = []
        for d in docs:
            for i in range(len(d)):
                best = 0
                for j in range(len(d)):
                    k = 0
                    while i != j and max(i, j) + k < len(d) and d[i + k] == d[j + k]:
                        k += 1
                    best = max(best, k)
                want.append(best)
        assert quality_rules.repeat_lengths(codes, rows).tolist() == want


def test_quality_rules_odd_rows(odd, none):
    got = quality_rules.quality_rules(odd).collect()
    assert len(got) == len(ODD) and not any(r["kept"] for r in got)
    assert quality_rules.quality_rules(none).count() == 0


def brute_components(docs, size, percent):
    sets = []
    for i, t in docs:
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append((i, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())))
    label = {i: i for i, _ in sets}
    while True:
        before = dict(label)
        for (i, a), (j, b) in itertools.combinations(sets, 2):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[i] = label[j] = min(label[i], label[j])
        if label == before:
            return {i: (len(s), label[i]) for i, s in sets}


def test_jaccard_brute_force(spark):
    rng, docs = random.Random(2), []
    common = [f"c{k}" for k in range(30)]
    for base in range(12):
        text = [f"w{rng.randrange(400)}" for _ in range(rng.choice([2, 30, 80]))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(text)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(9)}"
            docs.append((len(docs), " ".join(copy + common * (base % 3 == 0)) + rng.choice(["", " "])))
    docs += [(500, None), (501, ""), (502, "A b"), (503, "a B")]
    for size, percent in ((3, 90), (1, 60)):
        got = jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), size=size, percent=percent, sketch_bits=12).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(docs, size, percent)


def test_jaccard_large_buckets(spark):
    """Many near copies, and many short texts that share a phrase but no link: sub-buckets, stars and mixed buckets."""
    rng, docs = random.Random(12), []
    base = [f"w{k}" for k in range(40)]
    for i in range(120):
        docs.append((i, " ".join(w if rng.random() > 0.02 else f"x{rng.randrange(300)}" for w in base)))
    docs += [(1000 + i, f"p q r s u{i} v{rng.randrange(60)} z{rng.randrange(60)}") for i in range(150)]
    docs += [(2000 + i, "same text of six words here") for i in range(100)] + [(3000 + i, "a b c d" + f" e{i % 3}") for i in range(90)]
    for size, percent in ((3, 50), (2, 80)):
        got = jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), size=size, percent=percent, sketch_bits=14).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(docs, size, percent)


def test_jaccard_odd_rows(odd, none):
    got = jaccard_join.jaccard_components(odd, sketch_bits=12).collect()
    assert len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["doc_id"] == 4} == {4}
    assert jaccard_join.jaccard_components(none, sketch_bits=12).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 60), (60, 60), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 50: 50, 60: 50}


def test_token_counts_equal_the_library(spark, odd):
    from tokenizers import Tokenizer, models

    model = token_counts.unigram_scores(token_counts.default_vocabulary())
    other = Tokenizer(models.Unigram([("<unk>", 0.0), *model[0].items()], 0))
    some = sorted({"hello", "help", "helping", "h", "internationalisation", "xqzt", "don't", "1234"})
    assert token_counts.trie_counts(some, model) == [len(other.encode(token_counts.START + w).ids) for w in some]
    assert [r["n_tokens"] for r in token_counts.token_counts(odd).collect() if r["n_words"] == 0] == [0, 0, 0]


def brute_features(text, bits):
    """Distinct features of a text by plain loops over its words."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    full, shift, out = 2**64, 64 - bits, set()

    def mix(x, seed):
        x ^= 0x9E3779B97F4A7C15 * (2 * seed + 1) % full
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % full
        x = (x ^ x >> 27) * 0x94D049BB133111EB % full
        return x ^ x >> 31

    h = [xxhash.xxh3_64_intdigest(x.encode(), 1) for x in w]
    for i, x in enumerate(w):
        out.add(mix(h[i], 1) >> shift)
        for gap in (1, 2):
            if i + gap < len(w):
                out.add(mix((h[i] * 3 + mix(h[i + gap], 5)) % full, 1 + gap) >> shift)
        for n in toxicity.STEMS:
            if len(x) > n:
                out.add(mix(xxhash.xxh3_64_intdigest(x[:n].encode(), 2), 10 + n) >> shift)
    return sorted(out)


def test_toxicity_features_brute_force():
    texts = ["Some words, AND some words again", None, "", "éa übermäßig word", "one", "a b c d a b c d", "x1 " * 50]
    x, at = toxicity.features(pa.array(texts), 18)
    assert [x[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [brute_features(t, 18) for t in texts]


def test_ftrl_brute_force():
    """The vector form against the published update, one coordinate at a time."""
    import math

    rng = random.Random(6)
    rows = [(sorted(rng.sample(range(30), rng.randrange(9))), rng.randrange(2)) for _ in range(300)]
    model, z, n = toxicity.FTRL(5, alpha=0.4, beta=0.7, l1=0.5, l2=0.3), [0.0] * 33, [0.0] * 33

    def weight(i):
        l1 = 0.0 if i == 0 else 0.5
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((0.7 + math.sqrt(n[i])) / 0.4 + 0.3)

    for x, label in rows:
        at = [0, *(i + 1 for i in x)]
        w = {i: weight(i) for i in at}
        p = 1 / (1 + math.exp(-sum(w.values())))
        assert abs(model.learn(np.array(x, np.int64), label) - p) < 1e-9
        for i in at:
            g = p - label
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.4 * w[i]
            n[i] += g * g
    at, weights, bias = model.sparse()
    want = {i: weight(i + 1) for i in range(32) if weight(i + 1)}
    assert at.tolist() == sorted(want) and np.allclose(weights, [want[i] for i in sorted(want)]) and abs(bias - weight(0)) < 1e-9


def brute_count(text, scores, unknown):
    """Tokens of the best segmentation by trying all: greatest sum of scores, then fewest tokens."""
    if not text:
        return 0.0, 0
    found = []
    for k in range(1, len(text) + 1):
        head = text[:k]
        if head in scores:
            rest = brute_count(text[k:], scores, unknown)
            found.append((scores[head] + rest[0], -1 - rest[1]))
        elif k == 1:
            rest = brute_count(text[1:], scores, unknown)
            found.append((unknown + rest[0], -len(head.encode()) - rest[1]))
    best = max(found)
    return best[0], -best[1]


def test_token_counts_brute_force(spark):
    """Shared prefixes, unknown and multi-byte characters, ties; scores are multiples of 1/4, so that sums are exact."""
    rng = random.Random(13)
    for _ in range(30):
        pieces = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 4))): -rng.randint(1, 12) / 4 for _ in range(9)} | {token_counts.START: -1.0, token_counts.START + "a": -1.5}
        model = (pieces, max(map(len, pieces)), -20.0)
        some = sorted({"".join(rng.choice("abé日x") for _ in range(rng.randint(0, 7))) for _ in range(25)})
        assert token_counts.trie_counts(some, model) == [brute_count(token_counts.START + w, pieces, -20.0)[1] for w in some]
    docs = spark.createDataFrame([(1, "help help\nhelping"), (1, "help"), (None, None), (2, "日本"), (3, "y" * 5000)], "doc_id long, text string")
    model = token_counts.unigram_scores(token_counts.default_vocabulary())
    got = token_counts.token_counts(docs.selectExpr("doc_id", "text", "1 as n_tokens", "'x' as n_words")).collect()
    want = [sum(token_counts.trie_counts([w], model)[0] for w in words(t)) for t in ("help help\nhelping", "help", None, "日本", "y" * 5000)]
    assert [r["n_tokens"] for r in got] == want and [r["n_words"] for r in got] == [3, 1, 0, 1, 1]
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_main_text_of_planted_articles(spark):
    """Articles in pages of several makes come out whole and alone; the cut decides where a block's own costs are wrong."""
    rng = random.Random(15)
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta rest of the long day".split()) for _ in range(n)).capitalize() + "."
    flips = 0
    for k in range(40):
        parts = [say(6)] + [say(rng.choice([2, 12, 40])) for _ in range(rng.randrange(3, 9))]
        body = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{x}</p>" for x in parts[1:])
        links = "<ul>" + "".join(f"<li><a href='/{i}'>{say(2)}</a></li>" for i in range(8)) + "</ul>"
        around = [f"<nav>{links}</nav>", f"<header><div>{say(4)}</div></header>", f"<div class='sidebar'>{links}<p>{say(9)}</p></div>", f"<div id='cookie-notice'><p>{say(25)}</p></div>"]
        after = [f"<section class='comments'><p>{say(30)}</p><p>{say(22)}</p></section>", f"<form><label>{say(2)}</label></form>", f"<footer>{say(7)}</footer>"]
        if k % 4 == 1:  # no article element: divs only
            parts = [say(20)] + [say(rng.choice([3, 30])) for _ in range(6)] + [say(25)]
            body = "<div>" + "".join(f"<div>{x}</div>" for x in parts) + "</div>"
        elif k % 4 == 2:  # a promising word against a real paragraph, in the midst of the article
            body = f"<article><h1>{parts[0]}</h1>" + "".join(f"<p>{x}</p>" for x in parts[1:]) + "</article>"
        else:
            body = f"<main><article>{body}<div class='ad'>{say(5)}</div></article></main>"
        page = "<html><head><title>t</title><script>x = '<p>no</p>'</script></head><body>" + "".join(around) + body + "".join(after) + "</body></html>"
        blocks = html_mincut.page_blocks(page)
        costs = [html_mincut.block_cost(b) for b in blocks]
        flips += sum((c > 0) != x for c, x in zip(costs, html_mincut.minimum_cut(costs, html_mincut.block_edges(blocks)), strict=True))
        assert html_mincut.main_text(page) == "\n\n".join(parts), (k, page)
    assert flips > 10


def test_main_text_of_long_and_broken_pages(spark):
    import time

    began = time.time()
    for page in ("<div>" * 200_000 + "<p>x</p>", '<p title="x>hello ' * 60_000, "<a" * 500_000, "<ul><li>x" * 100_000, "<!" * 300_000 + ">", "<script>" + "</scrip" * 100_000):
        html_mincut.main_text(page)
    assert time.time() - began < 20
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_mincut.extract_main_text(pages).count() == 0


def test_toxicity_learns_and_stands_odd_rows(spark, odd, none):
    docs = spark.createDataFrame([(i, f"nice {'idiot' if i % 2 else 'day'} w{i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.train(toxicity.training_rows(docs, labels), epochs=8, bits=16)
    got = toxicity.score(spark.createDataFrame([(1, "you idiot"), (2, "a day"), (3, None)], "doc_id long, text string"), model, bits=16).collect()
    assert got[0]["score"] > 0.5 > got[1]["score"] and 0 <= got[2]["score"] <= 1
    assert toxicity.score(odd, model, bits=16).count() == len(ODD) and toxicity.score(none, model, bits=16).count() == 0
    blank = toxicity.train(toxicity.training_rows(none, labels), bits=8)
    assert blank[2] == 0.0
    one = toxicity.train(toxicity.training_rows(docs, labels.where("toxic = 1")), bits=8)
    assert one[2] > 0 and not len(one[0])


def test_toxicity_training_rows(spark):
    """Bounded a label, held-out ids never, one row an id: the greatest label and the least text; ties and nulls."""
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(60)] + [(3, "a"), (3, "a"), (4, None), (None, "x"), (99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(4, 1), (None, 1), (5, None), (99, 1), (1000, 0)], "doc_id long, toxic int")
    got = {r["doc_id"]: (r["label"], r["text"]) for r in toxicity.training_rows(docs, labels, hold_out=True).collect()}
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    assert got == {i: (1 if i == 4 else i % 2, "a" if i == 3 else f"t{i}") for i in ids}
    few = toxicity.training_rows(docs, labels, max_rows_per_label=7).collect()
    assert sum(r["label"] == 0 for r in few) == 7 and sum(r["label"] == 1 for r in few) in (6, 7) and len({r["doc_id"] for r in few}) == len(few)


def test_very_long_repeats(spark):
    """One text of 4 MB that repeats all through: whole results, no history of ranks."""
    text = "word " * 800_000
    got = quality_rules.quality_rules(spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")).orderBy("doc_id").first()
    assert (got["n_words"], got["n_repeat_words"], got["longest_repeat"], got["n_covered_words"]) == (800_000, 800_000, 799_999, 800_000)


def brute_hits(text, items, window):
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    doc, hit, found = plain(text), set(), set()
    for item, t in items:
        w = plain(t)
        n = min(window, len(w))
        wins = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
        for k in range(len(doc) - n + 1) if w else ():
            if tuple(doc[k : k + n]) in wins:
                found.add(str(item))
                hit |= set(range(k, k + n))
    return len(doc), len(hit), sorted(found)


def test_decontamination_brute_force(spark, odd):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["a", "B", "é", "d-e", "f"]) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([1, 3, 4, 5, 7, 0])] + [(10, None), (11, "a b c d")]
    docs = [(i, say(rng.randrange(25))) for i in range(60)]
    got = decontaminate.benchmark_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=4).collect()
    for r, (_, t) in zip(sorted(got), docs, strict=True):
        assert (r["n_words"], r["n_hit"], r["items"]) == brute_hits(t, items, 4)
    # Several automata, a pass each: the same rows.
    parts = decontaminate.benchmark_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=4, max_nodes=9)
    assert sorted(parts.collect()) == sorted(got)
    one = decontaminate.benchmark_hits(spark.createDataFrame([(1, "Ünd -- Foo,BAR baz!")], "doc_id long, text string"), spark.createDataFrame([(1, "foo bar")], "item_id long, text string")).first()
    assert [(s["start"], s["end"]) for s in one["spans"]] == [(7, 14)]
    assert decontaminate.benchmark_hits(odd, spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0


def test_compaction_round_trip(spark, odd, tmp_path):
    store = compaction.sharded(odd, arrivals=5, path=f"file://{tmp_path}/s", fan_in=2)
    got = store.read()
    assert sorted(map(str, got.select(odd.columns).collect())) == sorted(map(str, odd.collect()))
    assert store.manifest().count() < 5 and set(got.columns) == {*odd.columns, "_shard", "_tier"} and got.where("_tier = 0").count() == len(ODD)
    with pytest.raises(RuntimeError):
        store._commit(store.manifest(), store.version(), store.schema())


def test_compaction_keeps_versions_for_readers(spark, tmp_path):
    """A reader of the version before the newest still finds its files; older ones go; a new column is null before."""
    store = compaction.ShardStore(spark, f"file://{tmp_path}/s", fan_in=3)
    for i in range(4):
        store.append(spark.createDataFrame([(i, "x")] if i < 3 else [(i, "x", 2)], "doc_id long, text string" + ", extra int" * (i == 3)).coalesce(1))
    store.vacuum()
    assert store.versions() == [3, 4] and store.read(3).count() == 3
    store.compact()
    assert store.version() == 5 and store.manifest().count() == 1 and store.read(4).count() == 4
    assert sorted((r["doc_id"], r["extra"]) for r in store.read().collect()) == [(0, None), (1, None), (2, None), (3, 2)]
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("a",)], "Doc_id string"))


def test_compaction_of_empty_and_clashing(spark, none, tmp_path):
    store = compaction.sharded(none, arrivals=2, path=f"file://{tmp_path}/e")
    assert store.read().count() == 0 and store.read().columns[: len(none.columns)] == none.columns
    assert compaction.ShardStore(spark, f"file://{tmp_path}/n").read().count() == 0
    rows = spark.createDataFrame([(1, "a", 5, "m"), (2, None, None, None), (2, None, None, None)], "doc_id long, _Shard string, `__shard` int, _metadata string")
    got = compaction.sharded(rows, arrivals=2, path=f"file://{tmp_path}/c", fan_in=2).read()
    assert sorted(map(str, got.select(rows.columns).collect())) == sorted(map(str, rows.collect())) and got.columns[-2:] == ["___shard", "_tier"]


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(0).integers(0, 2**bits, 1001, dtype=np.uint64).astype(np.uint32)
    raw = bitpack.pack(ids, bits)
    assert len(raw) == -(-1001 * bits // 8) and (bitpack.unpack(raw, bits, 1001) == ids).all()


def library_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_text_ids_equal_the_library():
    texts = [None, "", "İstanbul ΣΑΣ é x²", "don't DON'T 'S a''s <|endoftext|>", "a\x00b\x85c", "日本語🙂", "A_B-C...12,345 ＡＢ", "ß ÿ ×÷µª\n"]
    ids, at = tokens.text_ids(pa.array(texts), tokens.vocabulary_path())
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [library_ids(t) for t in texts]


def test_ids_are_put_together_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    at = rng.integers(0, 1000, 1 << 20)
    offsets = np.concatenate(([0], np.cumsum(rng.integers(0, 6, 1000))))
    values = rng.integers(0, 49_000, int(offsets[-1])).astype(np.int32)
    tracemalloc.start()
    ids, starts = tokens._composed(values, offsets, at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (np.diff(starts) == np.diff(offsets)[at]).all() and ids.dtype == np.int32
    assert (ids == np.concatenate([values[offsets[i] : offsets[i + 1]] for i in at.tolist()])).all()
    assert peak < 2 * (ids.nbytes + starts.nbytes)
    ids, starts = tokens._composed(values, offsets, at[:0])
    assert len(ids) == 0 and starts.tolist() == [0]


@pytest.mark.parametrize("mapped", [True, False])
def test_workers_give_memory_back_between_slices(spark, mapped):
    pins = []

    def memory(batch):
        with open("/proc/self/smaps_rollup") as file:
            now = int(re.search(r"\nPss_Anon:\s+(\d+)", file.read())[1])
        some = [np.ones(12_000) for _ in range(1000)]  # 96 MB, free later but for a few parts among them
        pins.append(some[99::100])
        return now

    docs = spark.range(4, numPartitions=1).selectExpr("id as doc_id", "repeat('a', 1 << 20) as text", "cast(0 as long) as kb")
    if mapped:
        got = common.map_text(docs, lambda b: pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([memory(b)] * b.num_rows)], ["doc_id", "kb"]), "doc_id long, kb long", slice_bytes=1 << 20)
        kb = [r["kb"] for r in got.orderBy("doc_id").collect()]
    else:
        first = []

        def keep(batch):
            first.append(memory(batch))
            return np.full(batch.num_rows, first[-1] < first[0] + 50_000)

        kb = [0] * common.filter_text(docs, keep, slice_bytes=1 << 20).count()
    assert len(kb) == 4 and max(kb) < kb[0] + 50_000


def test_token_files_round_trip(spark, odd, none):
    got = sorted(bitpack.token_files(odd, tokens.vocabulary_path(), block_ids=100).collect(), key=lambda r: r["start"])
    order = sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0))
    start = 0
    for r, (i, t) in zip(got, order, strict=True):
        ids = library_ids(t)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert bitpack.token_files(none, tokens.vocabulary_path()).count() == 0


def test_added_tokens_as_the_plain_call(spark):
    """Token files and pieces have the ids of an untouched tokenizer, texts with added tokens among them."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.vocabulary_path())
    texts = ["hello <|endoftext|> world", "a<|endoftext|><|startoftext|>B", "<|ENDOFTEXT|> <|end oftext|>", "é<|startoftext|>\u0301日\x85<|endoftext|>", "<|endoftext|>" * 3, "plain", ""]
    want = [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert want[0] == [3306, 49407, 1002, 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    files = bitpack.token_files(docs, tokens.vocabulary_path()).collect()
    sums = [zlib.crc32(np.array(ids, "<u4").tobytes()) for ids in want]
    starts = [0, *itertools.accumulate(map(len, want))]
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in files) == [(i, starts[i], len(ids), sums[i]) for i, ids in enumerate(want)]
    pieces = packing.pack_documents(docs, tokens.vocabulary_path()).collect()
    assert sorted((r["doc_id"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces) == [(i, len(ids), sums[i], len(ids)) for i, ids in enumerate(want)]
    for special in (True, False):  # one worker may do both, in any order
        ids, at = tokens.text_ids(pa.array(texts), tokens.vocabulary_path(), added=not special)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == ([library_ids(t) for t in texts] if special else want)


def test_packing_is_gapless(spark, odd, none):
    rows = packing.pack_documents(odd, tokens.vocabulary_path(), capacity=64).collect()
    assert sum(r["length"] for r in rows) == sum(len(library_ids(t)) for _, t in ODD)
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(none, tokens.vocabulary_path()).count() == 0


def test_patterns_hold_every_piece():
    rng = random.Random(4)
    for _ in range(50):
        cap = rng.choice([8, 16, 40])
        h = {rng.randint(1, cap): rng.randint(1, 60) for _ in range(rng.randint(1, 9))}
        got = {}
        for count, held in packing.packing_patterns(h, cap):
            assert sum(n * k for n, k in held) <= cap
            for n, k in held:
                got[n] = got.get(n, 0) + count * k
        assert got == h


def test_minimum_cut_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        n = rng.randint(1, 8)
        costs = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 6)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.4]
        value = lambda s: sum(abs(c) for c, k in zip(costs, s, strict=True) if (c > 0) != bool(k) and c) + sum(w for a, b, w in edges if s[a] != s[b])  # noqa: B023, E731
        assert value(html_mincut.minimum_cut(costs, edges)) == min(value(s) for s in itertools.product([0, 1], repeat=n))


def test_main_text():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=x>Home</a></header><nav><ul><li>Menu</ul></nav>
    <div class="cookie-notice"><p>We use cookies to give you the best experience.</div><main><article><h1>Title &amp; more</h1><p>First <b>bold</b>
    paragraph<br>of text.<p>Second one, with an <a href=y>inline link</a> in it.<script>var x = "</p>";</script></p><div class="ad">Buy now, it is cheap!</div><ul><li>Point one</ul></article></main>
    <section id="comments"><p>Nice article, I read all of it with great joy.</p></section><form><label>Mail</label></form><footer>&copy; someone</footer>"""
    want = "Title & more\n\nFirst bold paragraph of text.\n\nSecond one, with an inline link in it.\n\nPoint one"
    assert html_mincut.main_text(page) == want
    assert html_mincut.main_text(None) == html_mincut.main_text("") == html_mincut.main_text("<p>") == ""


def test_main_text_null_rows(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (None, "u", "<article><p>Hi there &lt;x&gt;</article>", 2)], "page_id long, url string, html string, n_chars int")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in html_mincut.extract_main_text(pages).collect()}
    assert got == {1: (None, "", 0), None: ("u", "Hi there <x>", 12)}


def test_tool_links(spark):
    import json

    rows = [(1, 0, "user", 'say "hi"\n\x01ü'), (1, 1, "assistant", "hi\\"), (1, 2, "user", None), (1, 5, "assistant", "late"), (None, 0, "user", "x"), (2, 0, "user", ""), (2, None, "assistant", "y")]
    got = tool_links.formatted_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {(r["conv_id"], r["turn"], r["result_turn"]): r for r in got}
    assert by[1, 0, 1]["status"] == "linked" and by[1, 2, None]["status"] == "pending" and not by[1, 2, None]["valid"]
    assert by[1, None, 5]["status"] == "orphan" and len(got) == 6
    record = json.loads(by[1, 0, 1]["json"])
    assert record["call"]["arguments"]["prompt"] == rows[0][3] and by[1, 0, 1]["json"] == json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_tool_links_keep_every_turn(spark):
    """Turns of other roles and further results of a call, copies and null texts among them, are rows too."""
    import json

    rows = [(1, 0, "system", 'be "brief"'), (1, 1, "user", "q"), (1, 2, "assistant", "b"), (1, 2, "assistant", "a"), (1, 2, "assistant", "a"), (1, 3, None, "odd"), (1, 4, "tool", None)]
    rows += [(2, 0, "user", "p"), (2, 1, "assistant", None), (2, 1, "assistant", "z"), (None, None, "system", "lost")]
    got = tool_links.formatted_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    records = [(r, json.loads(r["json"])) for r in got]
    assert all(r["json"] == json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) and r["status"] == x["status"] for r, x in records)
    told = [(r["conv_id"], x["message"]["turn"], x["message"]["role"], x["message"]["text"]) for r, x in records if r["status"] == "message"]
    told += [(r["conv_id"], r["turn"], "user", x["call"]["arguments"]["prompt"]) for r, x in records if x["call"]]
    told += [(r["conv_id"], r["result_turn"], "assistant", x["result"]) for r, x in records if r["result_turn"] is not None]
    assert sorted(told, key=str) == sorted(rows, key=str)
    by = {(r["conv_id"], r["status"], x["result"]): r for r, x in records}
    assert by[1, "linked", "a"]["n_results"] == 3 and by[2, "linked", None]["n_results"] == 2
    assert by[1, "surplus", "b"]["call_id"] == "1:1" and by[1, "surplus", "a"]["n_results"] == 0 and by[2, "surplus", "z"]["valid"]


def test_call_levels(spark):
    calls = spark.createDataFrame([(1, x) for x in "abcdxy"], "conv_id long, call_id string")
    needs = spark.createDataFrame([(1, "b", "a"), (1, "c", "b"), (1, "c", "a"), (1, "x", "y"), (1, "y", "x"), (1, "d", "unknown")], "conv_id long, call_id string, needs_id string")
    got = {r["call_id"]: r["level"] for r in tool_links.call_levels(calls, needs).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 0, "x": None, "y": None}


def test_call_levels_of_long_chains(spark):
    """A chain of 300 calls takes a few doubling rounds; its levels are whole."""
    calls = spark.createDataFrame([(1, f"c{i}", 300 - i) for i in range(300)], "conv_id long, call_id string, turn long")
    needs = spark.createDataFrame([(1, f"c{i + 1}", f"c{i}") for i in range(299)] * 2, "conv_id long, call_id string, needs_id string")
    got = {r["call_id"]: (r["level"], r["after_turn"]) for r in tool_links.call_levels(calls, needs).collect()}
    assert got == {f"c{i}": (i, 300) for i in range(300)}


def test_call_levels_brute_force(spark):
    rng, calls, needs = random.Random(8), [], []
    for conv in range(30):
        n = rng.randrange(1, 12)
        calls += [(conv, f"c{i}") for i in range(n)]
        needs += [(conv, f"c{rng.randrange(n)}", f"c{rng.randrange(n)}") for _ in range(rng.randrange(0, n + 3))]
    level, edges = {}, {x: {(c, b) for c, a, b in needs if (c, a) == x} for x in calls}
    while ready := [x for x in calls if x not in level and all(y in level for y in edges[x])]:
        level |= {x: 1 + max((level[y] for y in edges[x]), default=-1) for x in ready}
    got = tool_links.call_levels(spark.createDataFrame(calls, "conv_id long, call_id string"), spark.createDataFrame(needs, "conv_id long, call_id string, needs_id string")).collect()
    assert len(got) == len(calls) and {(r["conv_id"], r["call_id"]): r["level"] for r in got} == {x: level.get(x) for x in calls} and None in {r["level"] for r in got}


def test_order_key_is_topological(spark):
    """A call sorts after all that it depends on, later turns and long chains among them; needs come from the turns by default."""
    rows = [(1, t, "user", f"q{t}") for t in range(0, 16, 2)] + [(1, 1, "assistant", "r"), (1, 1, "assistant", "s")]
    chain = [(1, f"1:{b}", f"1:{a}") for a, b in itertools.pairwise([14, 12, 10, 8, 6, 0])] + [(1, "1:2", "1:4"), (1, "1:4", "1:2")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    needs = spark.createDataFrame(chain, "conv_id long, call_id string, needs_id string")
    got = [(r["order_key"], r["status"], r["turn"]) for r in tool_links.formatted_conversations(turns, needs=needs).collect()]
    assert [x[1:] for x in sorted(got)] == [("pending", 2), ("pending", 4), ("pending", 14), ("pending", 12), ("pending", 10), ("pending", 8), ("pending", 6), ("linked", 0), ("surplus", None)]
    plain = tool_links.formatted_conversations(turns).collect()
    assert {r["turn"]: r["level"] for r in plain if r["status"] != "surplus"} == {0: 0, 2: 1, **dict.fromkeys(range(4, 16, 2), 0)}
    assert [r["turn"] for r in sorted(plain, key=lambda r: r["order_key"])][:4] == [0, None, 2, 4]


def test_tool_links_of_empty_long_and_clashing(spark):
    kinds = "conv_id long, turn long, role string, text string, level int, status string, call_id string"
    assert tool_links.formatted_conversations(spark.createDataFrame([], kinds)).count() == 0
    rows = [(1, 0, "user", "x" * 3_000_000, 7, "odd", "z"), (1, 1, "assistant", None, None, None, None), (1, 0, "user", "", 7, "odd", "z")]
    got = sorted(tool_links.formatted_conversations(spark.createDataFrame(rows, kinds)).collect(), key=lambda r: len(r["json"]))
    assert [(r["call_id"], r["status"], r["valid"], r["problems"]) for r in got] == [("1:0", "linked", False, "prompt: too short"), ("1:0", "linked", False, "prompt: too long")]


def test_bitmaps_never_exceed_unshared_shingles():
    """Differing bits bound the symmetric difference from below, for empty, short, repeated and long texts."""
    texts = pa.array(["", None, " ", "a", "a b", "a b c d", "a b c d e", "a b a b a b", "a b a b a b", " ".join(f"w{i % 700}" for i in range(3000)), " ".join(f"w{i}" for i in range(3000))] * 60)
    values, offsets = jaccard_join.shingle_sets(texts, 3)
    bits = jaccard_join.bitmaps(values, offsets).view(np.uint64).reshape(len(texts), -1)
    sets = [set(values[a:b].tolist()) for a, b in zip(offsets, offsets[1:])]
    for i in (*range(11), *range(len(texts) - 11, len(texts))):
        for j in range(11):
            assert sum(int(x).bit_count() for x in bits[i] ^ bits[j]) <= len(sets[i] ^ sets[j])
        assert (bits[i] == bits[i % 11]).all()


def test_links_between_classes_are_complete(spark, none):
    """Every pair of classes that reaches the threshold, also within one component; two words, 50 %."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(w if rng.random() > 0.08 else f"x{rng.randrange(40)}" for w in base)) for i in range(40)]
    docs += [(100 + i, docs[i][1]) for i in range(5)] + [(200 + i, " ".join(f"w{rng.randrange(6)}" for _ in range(8))) for i in range(30)] + [(300, None), (301, "one")]
    sets = {}
    for i, t in sorted(docs):
        w = words((t or "").lower())
        if w:
            sets.setdefault(frozenset(tuple(w[k : k + 2]) for k in range(max(len(w) - 1, 1))), i)
    want = {tuple(sorted((i, j))) for (a, i), (b, j) in itertools.combinations(sets.items(), 2) if 2 * len(a & b) >= len(a | b)}
    got = [tuple(r) for r in jaccard_join.jaccard_links(spark.createDataFrame(docs, "doc_id long, text string"), size=2, percent=50).collect()]
    assert len(want) > 100 and len(got) == len(want) and set(got) == want
    assert jaccard_join.jaccard_links(none).count() == 0


def test_no_bitmaps_of_no_sets():
    values, offsets = jaccard_join.shingle_sets(pa.array([], pa.string()), 3)
    assert len(values) == 0 and len(jaccard_join.bitmaps(values, offsets)) == 0
