"""Scalar text functions as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Lower-case letters that Unicode composes of one letter and marks, and those letters."""
    marked, plain = [], []
    for code in range(0xC0, 0x2000):
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        if letter == letter.lower() and len(parts) > 1 and parts[0].isalpha() and all(unicodedata.category(c) == "Mn" for c in parts[1:]):
            marked.append(letter)
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


ACCENTED, PLAIN = _folding()
#: Marks that stand alone, as in decomposed text.
MARKS = "[\\u0300-\\u036f]"


def fold(text: Column) -> Column:
    """Lower case without diacritics, composed or not."""
    return F.translate(F.regexp_replace(F.lower(text), MARKS, ""), ACCENTED, PLAIN)


def index_tokens(text: Column) -> Column:
    """Runs of letters and digits, folded; what the lexical index holds."""
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def quality_tokens(text: Column) -> Column:
    """Distinct ASCII tokens of three characters or more, lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]{3,})"), F.lit(1)))


def sparse_tokens(text: Column) -> Column:
    """Terms of the TF sparse encoder."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9][a-z0-9_\-/]{2,})"), F.lit(1))


def clean_sparse_term(term: Column) -> Column:
    """Without subword markers and edge punctuation; null if under 3 characters or all digits."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(term, r"^(##|▁|Ġ|</w>)+|(</w>)$", "")), r"""^[-_'"`]+|[-_'"`]+$""", "")
    return F.when((F.length(bare) >= 3) & ~bare.rlike(r"^\d+$"), bare)


def coverage(tokens: Column, text: Column) -> Column:
    """Share of tokens that occur in the lower-cased text; 0 without tokens."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.size(tokens) > 0, F.size(F.filter(tokens, lambda t: F.contains(low, t))) / F.size(tokens)).otherwise(F.lit(0.0))


def normalise_label(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", " "))


def slug(label: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(bare == "", "unknown").otherwise(bare)


def word_count(text: Column) -> Column:
    """Runs of two ASCII letters or more."""
    return F.regexp_count(text, F.lit("[A-Za-z]{2,}"))


def concise(text: Column, limit: int = 600) -> Column:
    """text if it is at most limit characters, else whole sentences until they reach the limit, cut there."""
    acc = F.aggregate(F.split(text, r"\. "), F.lit(""), lambda a, s: F.when(F.length(a) >= limit, a).when(a == "", s).otherwise(F.concat(a, F.lit(". "), s)))
    return F.when(F.length(text) <= limit, text).otherwise(F.substring(acc, 1, limit))


def measurement_id(parameter: Column, value: Column, unit: Column, doc: Column, chunk: Column) -> Column:
    joined = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (parameter, value, unit, doc, chunk)])
    return F.substring(F.sha2(joined, 256), 1, 16)


def uuid5(namespace: Column, name: Column) -> Column:
    """RFC 4122 version 5 from a namespace UUID's text and a name."""
    digest = F.sha1(F.concat(F.unhex(F.replace(namespace, F.lit("-"), F.lit(""))), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(3).bitwiseOR(8)))
    hexed = F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))
    return F.concat_ws("-", *[F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def pages_of(text: Column) -> Column:
    """All digit runs of a string as integers."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))


def json_or_raw(value: Column) -> Column:
    """A JSON value without white space; what doesn't parse as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(value)), value)


def section_parts(value: Column) -> Column:
    """Parts of a section path: those of a JSON list, else of text split at >, trimmed; empty ones left out."""
    listed = F.when(F.trim(value).startswith("["), F.from_json(value, "array<string>"))
    split = F.transform(F.split(value, ">"), lambda x: F.trim(x))
    return F.coalesce(F.filter(F.coalesce(listed, split), lambda x: x != ""), F.array().cast("array<string>"))


def gold_question(snippet: Column, section: Column, name: Column) -> Column:
    """The question that asks for a snippet, of at most 120 characters, in a section of a document."""
    quoted, label = F.substring(snippet, 1, 120), F.array_join(section, " > ")
    inside = F.format_string('Which passage in "%s" discusses "%s" in %s?', label, quoted, name)
    return F.when(label != "", inside).otherwise(F.format_string('Where in %s is the phrase "%s" explained?', name, quoted))


def reranker_window(value: Column, chars: int = 900) -> Column:
    """What a reranker reads of a text."""
    return F.substring(value, 1, chars)


def embed_window(value: Column, chars: int = 500) -> Column:
    """What an embedding server reads of a text."""
    return F.substring(value, 1, chars)


def subjects(user: dict | None = None, roles: tuple[str, ...] = (), tenant: str | None = None) -> list[str]:
    """Lower-cased subjects of a request, each once: user, email, its roles, further roles, tenant; user:anonymous without any; always * at the end."""
    user = user or {}
    given = [("user", user.get("id")), ("email", user.get("email")), *(("role", r) for r in (*(user.get("roles") or ()), *roles)), ("tenant", tenant)]
    found = list(dict.fromkeys(f"{kind}:{value}".strip().lower() for kind, value in given if value))
    return [*(found or ["user:anonymous"]), "*"]


def scope_boosts(scope: dict | None) -> dict[str, float]:
    """Boosts by document id: those of "boost", then of "demote", each at least 0; what is no number is left out."""
    out = {}
    for part in ("boost", "demote"):
        for doc, value in ((scope or {}).get(part) or {}).items():
            try:
                out[str(doc)] = max(0.0, float(value))
            except (TypeError, ValueError):
                continue
    return out
