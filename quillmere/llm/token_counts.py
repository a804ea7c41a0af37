"""Token counts under a unigram model, by dynamic programming that words with one prefix share.

A slice's distinct pre-tokens, in sorted order, are a depth-first walk of their trie: going from one to
the next keeps the forward scores of their common prefix, so each trie node's score is made once. The
count at the node where a pre-token ends is stored for it. Pieces come from a public vocabulary file;
the score of the piece of rank r is log of 1 / (r + 1) over the sum of all (Zipf), as that file has
no unigram scores and nothing is trained. A character outside the vocabulary counts its UTF-8 bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, map_text, only

START = "▁"
#: Bytes of text whose words are counted at once.
SLICE = 8 << 20
#: Added to the least score for a character that no piece holds.
UNKNOWN = -10.0
#: Distinct pre-tokens whose counts a Python worker keeps between slices.
CACHE = 500_000
#: Letters of the longest pre-token whose count is kept, so that what is kept is bounded in bytes too.
LONGEST = 64
_MODELS: dict[str, tuple[dict[str, float], int, float]] = {}
_COUNTS: dict[str, dict[str, int]] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def unigram_scores(path: str) -> tuple[dict[str, float], int, float]:
    """(score of each piece, letters of the longest, score of an unknown character)"""
    if path not in _MODELS:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        total = math.log(sum(1 / (r + 1) for r in range(len(names))))
        scores = {x: -math.log(r + 1) - total for r, x in enumerate(names)}
        _MODELS[path] = (scores, max(map(len, scores)), min(scores.values()) + UNKNOWN)
    return _MODELS[path]


def trie_counts(words: list[str], model: tuple[dict[str, float], int, float]) -> list[int]:
    """Tokens of the best segmentation of START + word for each of the sorted words; of equally good
    ones that with fewer tokens."""
    scores, longest, unknown = model
    best, tokens, out, last = [0.0], [0], [], ""
    get = scores.get
    for word in words:
        text = START + word
        shared, end = 0, min(len(text), len(last))
        while shared < end and text[shared] == last[shared]:
            shared += 1
        del best[shared + 1 :], tokens[shared + 1 :]
        for stop in range(shared + 1, len(text) + 1):
            top, count = -math.inf, 0
            for start in range(max(0, stop - longest), stop):
                piece = get(text[start:stop])
                if piece is None:
                    continue
                score = best[start] + piece
                if score > top or (score == top and tokens[start] + 1 < count):
                    top, count = score, tokens[start] + 1
            if text[stop - 1] not in scores:
                score = best[stop - 1] + unknown
                if score > top:
                    top, count = score, tokens[stop - 1] + len(text[stop - 1].encode())
            best.append(top)
            tokens.append(count)
        out.append(tokens[-1])
        last = text
    return out


def _counted(vocabulary: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, cache = unigram_scores(vocabulary), _COUNTS.setdefault(vocabulary, {})
        if len(cache) > CACHE:
            cache.clear()
        codes, offsets, words = ascii_words(batch.column("text"))
        names = words.to_pylist()
        new = sorted({w for w in names if w not in cache})
        made = dict(zip(new, trie_counts(new, model), strict=True))
        counts = np.fromiter((made[w] if w in made else cache[w] for w in names), np.int64, len(names))
        cache.update((w, n) for w, n in made.items() if len(w) <= LONGEST)
        sums = np.concatenate(([0], np.cumsum(counts[codes])))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(sums[offsets[1:]] - sums[offsets[:-1]])], ["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens), a row for each row of docs. A pre-token is START and a word
    ``[^\\x20\\x09-\\x0D]+``. Null, empty and blank texts have 0 of both; an empty table gives none; repeated rows and
    null ids stay, a row each; other columns play no part. No shuffle; a worker holds the counts of at most CACHE words and a slice's."""
    docs = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_text(docs, _counted(vocabulary or default_vocabulary()), "doc_id long, n_words long, n_tokens long", slice_bytes=SLICE)
