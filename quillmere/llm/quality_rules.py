"""Repetition rules from a suffix array over the words of each text.

A suffix array of all texts of a slice is built at once by prefix doubling. Equal words of different
texts are different symbols, so suffixes of different texts share no prefix and every interval of
equal prefixes lies inside one text. Longest common prefixes come in text order (Kärkkäinen, Manzini
and Puglisi, "Permuted longest-common-prefix array", 2009): where the words before two neighbouring
suffixes are equal, the prefix is that of the position before less one; only the other, irreducible
ones are compared, and their sum is O(n log n). The deepest interval that a suffix lies in is the larger
of its two neighbours' prefixes, and that many words from its start are a maximal repeat's occurrence.
The union of those spans is what repeats.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, filled, filter_text, map_text, only, row_ids

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_covered_words long, longest_repeat long, spans array<struct<start:long,end:long>>, base_failed boolean, kept boolean"
)
SYMBOLS = "[#*$%&|<>]"


#: Words that one step of comparisons gathers.
STEP_WORDS = 1 << 20


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes' order and each suffix's place in it, by prefix doubling; symbols are small integers."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable").astype(np.int32)
    first = symbols[order]
    # A rank is the place of its group's first suffix, so ranks stay comparable while groups are split.
    rank = np.empty(n, np.int32)
    rank[order] = _heads(np.append(True, first[1:] != first[:-1]))
    counts = np.bincount(rank, minlength=n)
    open_at, step = np.flatnonzero(counts[rank] > 1).astype(np.int32), 1
    del first, counts
    while len(open_at):  # only suffixes that still share their rank need a longer key
        follow = open_at.astype(np.int64) + step
        second = np.where(follow < n, rank[np.minimum(follow, n - 1)].astype(np.int64) + 1, 0)
        key = rank[open_at].astype(np.int64) * (n + 1) + second
        by = np.argsort(key, kind="stable")
        key, open_at = key[by], open_at[by]
        group = key // (n + 1)
        head = _heads(np.append(True, key[1:] != key[:-1]))
        start = _heads(np.append(True, group[1:] != group[:-1]))
        rank[open_at] = (group + head - start).astype(np.int32)
        alone = np.append(head[1:] != head[:-1], True) & np.append(True, head[1:] != head[:-1])
        open_at, step = open_at[~alone], 2 * step
    order[rank] = np.arange(n, dtype=np.int32)
    return order, rank


def _heads(new: np.ndarray) -> np.ndarray:
    """For each place the last one at or before it where new is set."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new), dtype=np.int32), 0))


def _common(symbols: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Words that the suffixes at left and right have in common, compared in runs of growing length."""
    n, out = len(symbols), np.zeros(len(left), np.int32)
    for low in range(0, len(left), STEP_WORDS):
        part = np.arange(low, min(low + STEP_WORDS, len(left)))
        width = 1
        while len(part):
            rest = []
            each = max(1, STEP_WORDS // width)
            for some in (part[i : i + each] for i in range(0, len(part), each)):
                reach = np.arange(min(width, n), dtype=np.int64)
                at, to = (x[some].astype(np.int64)[:, None] + out[some][:, None] + reach for x in (left, right))
                same = (symbols[np.minimum(at, n - 1)] == symbols[np.minimum(to, n - 1)]) & (np.maximum(at, to) < n)
                whole = same.all(axis=1)
                out[some] += np.where(whole, same.shape[1], same.argmin(axis=1)).astype(np.int32)
                rest.append(some[whole])
            part, width = np.concatenate(rest), min(2 * width, STEP_WORDS)
    return out


def repeat_lengths(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each word position, the words of the longest substring that starts there and occurs
    elsewhere in the same text (0: none)."""
    n = len(codes)
    if n < 2:
        return np.zeros(n, np.int32)
    key = rows.astype(np.int64) * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    symbols = np.empty(n, np.int32)
    symbols[order] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]), dtype=np.int32)
    del key, order
    array, rank = suffix_array(symbols)
    # Each suffix with the one before it in the array; the first has none and shares nothing.
    before = np.empty(n, np.int32)
    before[array[1:]] = array[:-1]
    before[array[0]] = n
    place = np.arange(n, dtype=np.int32)
    reducible = np.zeros(n, bool)
    some = np.flatnonzero((before[1:] > 0) & (before[1:] < n)) + 1
    reducible[some] = symbols[some - 1] == symbols[before[some] - 1]
    at = np.flatnonzero(~reducible & (before < n)).astype(np.int32)
    own = np.zeros(n, np.int32)
    own[at] = _common(symbols, at, before[at])
    last = _heads(~reducible)
    shared = own[last] - (place - last)
    shared[array[0]] = 0
    longest = shared.copy()
    longest[array[:-1]] = np.maximum(longest[array[:-1]], shared[array[1:]])
    return longest


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in the union of the spans."""
    delta = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(delta)[:n] > 0


def _duplicate_lines(texts: list[str]) -> list[int]:
    out = []
    for text in texts:
        lines = text.split("\n")
        if len(lines) == 1:
            out.append(0)
            continue
        with_words = [x for x in lines if x.strip(" \t\n\v\f\r")]
        out.append(len(with_words) - len(set(with_words)))
    return out


#: Bytes of text whose suffix array is built at once: some 60 bytes a word are held.
SLICE = 4 << 20


@dataclass(frozen=True)
class Rules:
    """The thresholds of ``quality_rules``."""

    min_words: int = 50
    window: int = 3
    max_window_percent: int = 50
    min_repeat_words: int = 10
    max_covered_percent: int = 30
    max_repeat_words: int = 100


def _measured(rules: Rules):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = filled(batch.column("text"))
        codes, offsets, words = ascii_words(texts)
        n, rows = len(codes), row_ids(offsets)
        count = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])
        longest = repeat_lengths(codes, rows)
        total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[offsets])
        wide = np.flatnonzero(longest >= rules.window)
        in_window = covered(wide, np.full(len(wide), rules.window), n)
        far = np.flatnonzero(longest >= rules.min_repeat_words)
        in_repeat = covered(far, longest[far], n)
        top = np.zeros(len(offsets) - 1, np.int64)
        if len(far):
            heads = np.flatnonzero(np.append(True, rows[far][1:] != rows[far][:-1]))
            top[rows[far[heads]]] = np.maximum.reduceat(longest[far], heads)
        # Runs of covered words; a run never crosses into the next text.
        at = np.flatnonzero(in_repeat)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (rows[at[1:]] != rows[at[:-1]])
        first = at[new]
        last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] if len(at) else at
        per_text = np.bincount(rows[first], minlength=len(offsets) - 1)
        spans = pa.StructArray.from_arrays([pa.array(first - offsets[rows[first]]), pa.array(last + 1 - offsets[rows[last]])], ["start", "end"])
        chars = np.asarray(pc.utf8_length(words), dtype=np.int64)
        n_words, n_repeat, n_covered = np.diff(offsets), count(in_window), count(in_repeat)
        failed = (n_words < rules.min_words) | (100 * n_repeat > rules.max_window_percent * n_words)
        kept = ~failed & (100 * n_covered <= rules.max_covered_percent * n_words) & (top <= rules.max_repeat_words)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n_words),
                pa.array(total(chars[codes]) if n else np.zeros(len(offsets) - 1, np.int64)),
                pc.count_substring_regex(texts, SYMBOLS).cast(pa.int64()),
                pa.array(_duplicate_lines(texts.to_pylist()), pa.int64()),
                pa.array(n_repeat),
                pa.array(n_covered),
                pa.array(top),
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_text))).astype(np.int32)), spans),
                pa.array(failed),
                pa.array(kept),
            ],
            ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat", "spans", "base_failed", "kept"],
        )

    return run


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Counts, repeat spans (in words) and verdicts, one row for each row of ``docs``.

    base_failed: fewer than min_words words, or windows of ``window`` words found twice or more hold
    over max_window_percent of the words. kept: not base_failed, repeats of min_repeat_words or more
    hold at most max_covered_percent of the words, and none is longer than max_repeat_words.
    A null or empty text has no words, fails the base rule and isn't kept. Null and repeated ids
    stay as they are, a row each; an empty table gives none. Other columns of docs don't matter. No shuffle; memory is bounded
    by a slice of SLICE bytes of text, or by one text if that is longer, however much it repeats.
    """
    chosen = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_text(chosen, _measured(rules), SCHEMA, slice_bytes=SLICE)


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of docs, with all their columns, whose verdict by ``quality_rules`` is kept. No shuffle."""
    measured = _measured(rules)
    return filter_text(docs, lambda batch: measured(batch).column("kept"), text_col, id_col, SLICE)
