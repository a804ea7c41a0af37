"""Benchmark decontamination by one Aho-Corasick automaton over the items' word windows.

Texts are normalised byte for byte (A-Z lower-cased, other ASCII but digits and letters to spaces),
so a word of the normalised text starts and ends where it does in the original. Each distinct word of
the benchmark has a number, every other word is 0, and a text becomes a string of DIGITS characters a word, the
first from an alphabet of its own, so that matches begin at words. The automaton holds every window as
such a string, its nodes have few children, and each text is scanned once; a match's place is a word
number, which the offsets of the normalised text map to the original.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, dropped, filled, filter_text, letters_and_digits, map_text, only, written

SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
#: The automaton that this Python worker built last, under the name of its benchmark's broadcast.
_BUILT: dict[str, tuple] = {}


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, words) for each window of each item; an item of fewer words, but not none, is one window."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    last = F.greatest(F.size("w") - window, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("w", i + 1, window), " "))
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words.alias("w")).where("item is not null and size(w) > 0")
    return items.select("item", F.explode(cut).alias("words")).distinct()


#: Characters a word's number has, of 32 values each.
DIGITS = 4


def _spelled(numbers: np.ndarray) -> np.ndarray:
    """DIGITS bytes for each word number; the first has another bit set."""
    out = np.empty((len(numbers), DIGITS), np.uint8)
    for i in range(DIGITS):
        out[:, i] = (numbers >> (5 * (DIGITS - 1 - i))) & 31
    out[:, 0] |= 32
    return out


def _groups(windows: DataFrame, max_nodes: int) -> int:
    """How many automata of at most about max_nodes words, and 8 letters for each, the windows need."""
    words, letters = F.size(F.split("words", " ")), F.ceil(F.length("words") / 8)
    size = windows.agg(F.sum(F.greatest(words.cast("long"), letters))).first()[0] or 0
    return max(1, -(-size // max_nodes))


def _fetched(windows: DataFrame) -> list[tuple[str, tuple[str, ...]]]:
    """(words, items) of each distinct window of a group, on the driver."""
    rows = windows.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items")).collect()
    return sorted((r["words"], tuple(r["items"])) for r in rows)


def _automaton(sent, key: str):
    """Built once in each Python worker for each broadcast; key names the broadcast."""
    if key not in _BUILT:
        import ahocorasick

        found, numbers = ahocorasick.Automaton(), {}
        windows = sent.value
        for i, (words, _) in enumerate(windows):
            number = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words.split(" ")])
            found.add_word(_spelled(number).tobytes().decode("latin-1"), (i, len(number)))
        if len(numbers) >= 1 << 5 * DIGITS:
            raise ValueError(f"a group of windows has {len(numbers)} distinct words; lower max_nodes")
        if windows:
            found.make_automaton()
        _BUILT.clear()
        _BUILT[key] = (found, numbers, [items for _, items in windows])
    return _BUILT[key]


def _scanned(sent, key: str):
    """Adds a group's hits to a slice: item ids found, and the hit words as runs (first word, one past the last)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton, numbers, items = _automaton(sent, key)
        codes, offsets, words = ascii_words(letters_and_digits(batch.column("text")))
        known = np.fromiter((numbers.get(w, 0) for w in words.to_pylist()), np.int64, len(words))
        spelled = _spelled(known)[codes].tobytes().decode("latin-1")
        before = zip(*(batch.column(n).to_pylist() for n in ("items", "runs")), strict=True)
        found_items, runs = [], []
        for n, (had, spans) in enumerate(before):
            low, high = int(offsets[n]), int(offsets[n + 1])
            hits = list(automaton.iter(spelled[DIGITS * low : DIGITS * high])) if len(automaton) and high > low else []
            if hits:
                delta = np.zeros(high - low + 1, np.int64)
                for first, end in spans:
                    delta[first] += 1
                    delta[end] -= 1
                which = set()
                for last, (i, width) in hits:
                    after = (last + 1) // DIGITS
                    delta[after - width] += 1
                    delta[after] -= 1
                    which.add(i)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(delta)[:-1] > 0).astype(np.int8), [0]))))
                spans = edges.reshape(-1, 2).tolist()
                had = sorted({*had, *(x for i in which for x in items[i])})
            found_items.append(had)
            runs.append(spans)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text"), pa.array(found_items, pa.list_(pa.string())), pa.array(runs, pa.list_(pa.list_(pa.int64())))], ["doc_id", "text", "items", "runs"]
        )

    return run


def _placed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Word counts, and runs of hit words as spans of the original text's characters."""
    texts = filled(batch.column("text"))
    plain = letters_and_digits(texts)
    offsets = ascii_words(plain)[1]
    n_hit, spans, span_at = [], [], [0]
    for n, runs in enumerate(batch.column("runs").to_pylist()):
        n_hit.append(sum(b - a for a, b in runs))
        if runs:
            spans += _original_spans(texts[n].as_py(), plain[n].as_buffer(), runs)
        span_at.append(len(spans))
    pairs = np.array(spans, np.int64).reshape(-1, 2)
    structs = pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["start", "end"])
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n_hit, pa.int64()), batch.column("items"), pa.ListArray.from_arrays(pa.array(span_at, pa.int32()), structs)],
        ["doc_id", "n_words", "n_hit", "items", "spans"],
    )


def _original_spans(original: str, plain: bytes, runs: list) -> list[tuple[int, int]]:
    """Character spans of the original text that runs of words hold."""
    raw = np.frombuffer(plain, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw < 14))
    inside = np.concatenate(([False], ~space, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    # Bytes to code points: count those that don't continue a character.
    letters = np.concatenate(([0], np.cumsum((np.frombuffer(original.encode(), np.uint8) & 0xC0) != 0x80)))
    return [(int(letters[starts[a]]), int(letters[ends[b - 1]])) for a, b in runs]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, max_nodes: int = 1 << 19) -> DataFrame:
    """Per row of docs: n_words, n_hit (words inside an occurrence of a window), items (ids as strings,
    sorted as strings, whose windows occur) and spans (characters of the original text).

    Null and empty texts have no words; items with a null id or without words are never found; equal
    item ids count as one item, repeated rows of docs stay, a row each. No shuffle of docs. An automaton holds windows of
    about max_nodes words in all (2**19: some 100 MB in a worker; some 5 MB of windows are broadcast). A larger
    benchmark is dealt to several automata by a hash of the window; each scans all texts in a pass of
    its own over a written table, and their hits are united, so results are the same.
    """
    spark = docs.sparkSession
    docs = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    windows = item_windows(only(benchmark, item_id=item_col, text=item_text_col), "item_id", "text", window)
    groups = _groups(windows, max_nodes)
    rows = docs.withColumns({"items": F.array().cast("array<string>"), "runs": F.array().cast("array<array<long>>")})
    for group in range(groups):
        some = windows if groups == 1 else windows.where(F.pmod(F.xxhash64("words"), F.lit(groups)) == group)
        scan = _scanned(spark.sparkContext.broadcast(_fetched(some)), uuid.uuid4().hex)
        if group < groups - 1:
            held, rows = rows, written(map_text(rows, scan, "doc_id long, text string, items array<string>, runs array<array<long>>"), "hits")
            dropped(held)
    return map_text(rows, lambda batch: _placed(scan(batch)), SCHEMA)


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, max_nodes: int = 1 << 19) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no window of the benchmark. No shuffle of docs; a
    benchmark of several automata filters in as many passes over written tables."""
    spark = docs.sparkSession
    windows = item_windows(only(benchmark, item_id=item_col, text=item_text_col), "item_id", "text", window)
    groups, rows = _groups(windows, max_nodes), docs
    for group in range(groups):
        some = windows if groups == 1 else windows.where(F.pmod(F.xxhash64("words"), F.lit(groups)) == group)
        scan = _scanned(spark.sparkContext.broadcast(_fetched(some)), uuid.uuid4().hex)

        def keep(batch: pa.RecordBatch, scan=scan) -> np.ndarray:
            none = pa.array([[]] * batch.num_rows, pa.list_(pa.string()))
            runs = pa.array([[]] * batch.num_rows, pa.list_(pa.list_(pa.int64())))
            found = scan(pa.RecordBatch.from_arrays([*batch.columns, none, runs], ["doc_id", "text", "items", "runs"]))
            return np.asarray(pc.list_value_length(found.column("runs"))) == 0

        held, rows = rows, filter_text(rows, keep, text_col, id_col)
        if group < groups - 1:
            rows = written(rows, "clean")
            dropped(held)
    return rows
