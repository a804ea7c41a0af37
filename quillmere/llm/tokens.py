"""Token ids of whole texts by the tokenizers library, at the cost of distinct words.

The word-level BPE splits at white space and drops it, so a text's ids are those of its white-space
separated pieces in order. Each slice's pieces are dictionary-coded by Arrow; a distinct piece is
lower-cased, split into pre-tokens, and each distinct pre-token goes once to the library's model.
Pieces outside printable ASCII and Latin-1 letters go whole through the library's own normaliser
and splitter, where Unicode details matter; so do pieces that hold a token added to the vocabulary
('<|endoftext|>'), which the library finds before it normalises.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ascii_words, gathered

#: Bytes of text that is tokenised at once: what is done once a distinct word is done less often in larger slices.
SLICE = 8 << 20
#: Distinct pre-tokens kept in a Python worker between slices; beyond that it starts anew.
CACHE = 500_000
#: Letters of the longest pre-token that is kept, so that what is kept is bounded in bytes too.
LONGEST = 64
#: The vocabulary file's own rule for splitting, within printable ASCII and Latin-1 letters.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+|[0-9]|[^a-z\x{df}-\x{f6}\x{f8}-\x{ff}0-9\s]+"
PLAIN = r"^[\x21-\x7E\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]*$"
_LOADED: dict[str, tuple] = {}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _loaded(path: str) -> tuple:
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        # The byte-level alphabet: printable bytes stand for themselves, the others for 256 and on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(printable))}
        added = tokenizer.get_added_tokens_decoder().values()
        if any(x.normalized or x.content.split() != [x.content] for x in added):
            raise ValueError(f"{path} adds tokens that hold white space or are found after normalising")
        _LOADED[path] = (tokenizer, alphabet, {}, [x.content for x in added])
    return _LOADED[path]


def vocabulary_size(path: str) -> int:
    return _loaded(path)[0].get_vocab_size()


def _ragged(lists: list) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    values = np.fromiter((x for y in lists for x in y), np.int32, int(lengths.sum()))
    return values, np.concatenate(([0], np.cumsum(lengths)))


#: Lists that are put together at once: the places of their ids take several times the ids' own memory.
STEP = 1 << 16


def _composed(values: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists numbered ``at``, one after the other, and where each begins."""
    lengths, starts = np.diff(offsets), np.zeros(len(at) + 1, np.int64)
    np.cumsum(lengths[at], out=starts[1:])
    out = np.empty(int(starts[-1]), values.dtype)
    for low in range(0, len(at), STEP):
        some = at[low : low + STEP]
        out[starts[low] : starts[low + len(some)]] = values[gathered(offsets[some], lengths[some])]
    return out, starts


def _pretoken_ids(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each pre-token, one after the other, and where each begins; new ones go to the model."""
    tokenizer, alphabet, cache, _ = _loaded(path)
    if len(cache) > CACHE:
        cache.clear()
    missing = [w for w in words if w not in cache]
    if missing:
        model = tokenizer.model
        found = (model.tokenize(w if w.isascii() else "".join([alphabet[b] for b in w.encode()])) for w in missing)
        ids, at = _ragged([[x.id for x in y] for y in found])
        raw, ends = ids.tobytes(), (4 * at).tolist()
        made = dict(zip(missing, (raw[a:b] for a, b in zip(ends, ends[1:], strict=False)), strict=True))
        cache.update((w, x) for w, x in made.items() if len(w) <= LONGEST)
        parts = [made[w] if w in made else cache[w] for w in words]
    else:
        parts = [cache[w] for w in words]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    return np.frombuffer(b"".join(parts), np.int32), np.concatenate(([0], np.cumsum(lengths)))


def piece_ids(pieces: pa.Array, path: str, added: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each distinct white-space separated piece, one after the other, and where each begins."""
    if not len(pieces):
        return np.empty(0, np.int32), np.zeros(1, np.int64)
    plain = np.array(pc.match_substring_regex(pieces, PLAIN))
    tokenizer, _, _, tokens = _loaded(path)
    for token in tokens if added else ():
        plain &= ~np.asarray(pc.match_substring(pieces, token))
    lower = pc.utf8_lower(pieces.filter(pa.array(plain)))
    # A space after each match of the split rule: what is between spaces is then a pre-token.
    split = pc.replace_substring_regex(lower, f"({SPLIT})", r"\1 ")
    codes, at, words = ascii_words(split)
    values, offsets = _pretoken_ids(words.to_pylist(), path)
    ids, starts = _composed(values, offsets, codes)
    starts = starts[at]
    if plain.all():
        return ids, starts
    tokenizer.encode_special_tokens = not added
    odd = [x.ids for x in tokenizer.encode_batch(pieces.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)]
    more, more_at = _ragged(odd)
    values, offsets = np.concatenate((ids, more)), np.concatenate((starts, starts[-1] + more_at[1:]))
    order = np.empty(len(plain), np.int64)
    order[plain], order[~plain] = np.arange(plain.sum()), plain.sum() + np.arange((~plain).sum())
    return _composed(values, offsets, order)


def text_ids(texts: pa.Array, path: str, end_id: int | None = 2, added: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text (null: empty) with end_id appended, one text after the other, and where each begins.

    added: tokens added to the vocabulary are one id where a text holds them, as by the library's plain
    call; else their letters are text like any other, as by encode_special_tokens."""
    codes, offsets, pieces = ascii_words(texts)
    values, starts = piece_ids(pieces, path, added)
    if end_id is not None:
        # The end id is one more piece, put after each text's last.
        values, starts = np.append(values, np.int32(end_id)), np.append(starts, starts[-1] + 1)
        codes = np.insert(codes, offsets[1:], len(starts) - 2)
        offsets = offsets + np.arange(len(offsets))
    ids, at = _composed(values, starts, codes)
    return ids, at[offsets]
