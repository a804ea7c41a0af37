"""Query tables against chunks' tokens, a slice of chunks at a time; what ``LexicalIndex`` runs in its tasks.

A chunk's score needs the chunk's own tokens and the counts of ``Matcher.frequencies`` only, so chunks stay where they are: a
task finds the units in its chunks, and either gives every match or keeps the best k of each query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..sources import store

#: Chunks and queries of one matrix, tokens of a slice at most (a chunk of more is a slice), rows that are held before they are cut to k a query.
CHUNKS, QUERIES, TOKENS, HELD = 1024, 256, 1 << 20, 1 << 20


class Matcher:
    def __init__(self, path: str):
        """Units from a table (query_id, rep, u) in the shared folder, u an array of (clause, terms). Queries of equal units are scored once, as their rep's;
        a null clause is one of its own. The table's units are held whole by each task."""
        terms, phrases, clauses, members = {}, {}, [], {}
        self.queries: list[int] = []
        for batch in store.batches(path):
            for query, rep, units in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                members.setdefault(rep, []).append(query)
                if query != rep:
                    continue
                found: dict = {}
                for i, unit in enumerate(units):
                    for t in unit["terms"]:
                        terms.setdefault(t, len(terms))
                    key = (None, i) if unit["clause"] is None else (unit["clause"], None)
                    found.setdefault(key, []).append(phrases.setdefault(tuple(terms[t] for t in unit["terms"]), len(phrases)))
                clauses.append(list(found.values()))
                self.queries.append(rep)
        self.members = [np.array(members[q], dtype=np.int64) for q in self.queries]
        self.terms, self.n_phrases = pa.array(list(terms), pa.string()), len(phrases)
        # A trie of phrases as sorted keys node * terms + term, its root 0.
        edges: dict[tuple[int, int], int] = {}
        ends = {}
        for phrase, number in phrases.items():
            node = 0
            for t in phrase:
                node = edges.setdefault((node, t), len(edges) + 1)
            ends[node] = number
        keys = np.array([n * max(1, len(terms)) + t for n, t in edges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], np.array(list(edges.values()), dtype=np.int64)[order]
        self.end = np.array([ends.get(i, -1) for i in range(len(edges) + 1)], dtype=np.int64)
        self.goes_on = np.zeros(len(edges) + 1, bool)
        self.goes_on[[n for n, _ in edges]] = True
        self.blocks = [self._block(clauses[i : i + QUERIES]) for i in range(0, len(clauses), QUERIES)]

    @staticmethod
    def _block(clauses: list[list[list[int]]]) -> tuple:
        """Of a block of queries: phrases; how often each stands alone in a query; of clauses with more units, phrases, sizes and queries."""
        used = np.unique(np.array([p for q in clauses for c in q for p in c], dtype=np.int64))
        at = {p: i for i, p in enumerate(used.tolist())}
        alone = np.zeros((len(used), len(clauses)))
        more = [(i, c) for i, q in enumerate(clauses) for c in q if len(c) > 1]
        holds, of = np.zeros((len(used), len(more))), np.zeros((len(more), len(clauses)))
        for i, q in enumerate(clauses):
            for c in q:
                if len(c) == 1:
                    alone[at[c[0]], i] += 1
        for j, (i, c) in enumerate(more):
            of[j, i] = 1
            for p in c:
                holds[at[p], j] += 1
        return used, alone, holds, holds.sum(0), of

    def found(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chunk, phrase, occurrences) of the phrases in a list column of tokens."""
        flat = np.asarray(pc.fill_null(pc.index_in(tokens.flatten(), value_set=self.terms), -1)).astype(np.int64)
        chunk = np.repeat(np.arange(len(tokens)), np.asarray(tokens.value_lengths()))
        at, node, depth, hits = np.flatnonzero(flat >= 0), 0, 0, []
        node = np.zeros(len(at), np.int64)
        while len(at):
            key = node * max(1, len(self.terms)) + flat[at + depth]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[i] == key
            at, node = at[known], self.nodes[i[known]]
            ended = self.end[node] >= 0
            hits.append(chunk[at[ended]] * self.n_phrases + self.end[node[ended]])
            depth += 1
            on = self.goes_on[node] & (at + depth < len(flat))
            at, node = at[on], node[on]
            on = (chunk[at + depth] == chunk[at]) & (flat[at + depth] >= 0)
            at, node = at[on], node[on]
        code, tf = np.unique(np.concatenate(hits) if hits else np.zeros(0, np.int64), return_counts=True)
        return code // max(1, self.n_phrases), code % max(1, self.n_phrases), tf

    def frequencies(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(phrase, n): in how many of the task's chunks each phrase occurs."""
        n = np.zeros(self.n_phrases, np.int64)
        for _, tokens in slices(batches):
            n += np.bincount(self.found(tokens)[1], minlength=self.n_phrases)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["phrase", "n"])

    def scores(self, batches: Iterator[pa.RecordBatch], idf: np.ndarray, avgdl: float, k1: float, b: float) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(chunk ids, first query, scores of chunks by queries): of a slice of chunks and a block of queries; 0 is no match."""
        for ids, tokens in slices(batches):
            chunk, phrase, tf = self.found(tokens)
            length = np.asarray(tokens.value_lengths())[chunk]
            weight = idf[phrase] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))
            for low in range(0, len(ids), CHUNKS):
                some = slice(*np.searchsorted(chunk, (low, low + CHUNKS)))
                dense = np.zeros((min(CHUNKS, len(ids) - low), self.n_phrases))
                dense[chunk[some] - low, phrase[some]] = weight[some]
                for i, (used, alone, holds, size, of) in enumerate(self.blocks):
                    mine = dense[:, used]
                    score = mine @ alone
                    if len(size):
                        score += (((mine > 0) @ holds == size) * (mine @ holds)) @ of
                    yield ids[low : low + CHUNKS], i * QUERIES, score


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Chunk ids and tokens of a batch, so many at a time that they have TOKENS tokens at most or are one chunk."""
    for batch in batches:
        ids, tokens = np.asarray(batch.column(0)), batch.column(1)
        total = np.cumsum(np.asarray(tokens.value_lengths()), dtype=np.int64)
        low = 0
        while low < len(ids):
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + TOKENS, side="right")))
            yield ids[low:high], tokens.slice(low, high - low)
            low = high


def best(query: np.ndarray, chunk: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, ties by the chunk."""
    order = np.lexsort((chunk, -score, query))
    query = query[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    order = order[rank < k]
    return query[rank < k], chunk[order], score[order]


def _rows(query: np.ndarray, chunk: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(query), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(x[low : low + (1 << 16)]) for x in (query, chunk, score)], ["query_id", "chunk_id", "bm25"])


def matches(matcher: Matcher, batches: Iterator[pa.RecordBatch], k: int | None, *weights) -> Iterator[pa.RecordBatch]:
    """(query_id, chunk_id, bm25), rounded to 6: every match of every query; with k the best k of the task's chunks, by the queries' reps only."""
    names = np.array(matcher.queries, dtype=np.int64)
    held: list[tuple] = []
    count = 0
    for ids, first, score in matcher.scores(batches, *weights):
        if k is None:
            chunk, query = np.nonzero(score)
            value = np.round(score[chunk, query], 6)
            each = [matcher.members[first + q] for q in range(score.shape[1])]
            n = np.array([len(x) for x in each])[query]
            yield from _rows(np.concatenate([each[q] for q in query]) if len(query) else np.zeros(0, np.int64), np.repeat(ids[chunk], n), np.repeat(value, n))
            continue
        value = np.round(score, 6)
        value[score == 0] = -np.inf
        if len(ids) > k:  # ties at the edge are kept whole, so that the id decides
            edge = -np.partition(-value, k - 1, axis=0)[k - 1]
            chunk, query = np.nonzero((value >= edge) & (score != 0))
        else:
            chunk, query = np.nonzero(score)
        found = best(first + query, ids[chunk], value[chunk, query], k)
        held.append(found)
        count += len(found[0])
        if count > max(HELD, 2 * k * len(names)):
            held = [best(*(np.concatenate(x) for x in zip(*held, strict=True)), k)]
            count = len(held[0][0])
    if held:
        query, chunk, value = best(*(np.concatenate(x) for x in zip(*held, strict=True)), k)
        yield from _rows(names[query], chunk, value)
