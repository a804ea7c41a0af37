"""Point, neighbour, outline and table lookups; access control; response profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Abbreviations and what they stand for.
ALIASES = {
    "MBR": ["membrane bioreactor"],
    "MLSS": ["mixed liquor suspended solids"],
    "SBR": ["sequencing batch reactor"],
    "BOD": ["biochemical oxygen demand"],
    "COD": ["chemical oxygen demand"],
    "P&ID": ["piping and instrumentation diagram", "PID"],
    "PLC": ["programmable logic controller"],
    "DAF": ["dissolved air flotation"],
    "RO": ["reverse osmosis"],
}
#: Fields of the slim and the full answer.
SLIM = ["chunk_id", "text", "doc_id", "path", "filename", "source_path", "mtime", "section_path", "page_numbers", "chunk_start", "chunk_end", "score", "route"]
FULL = [
    "chunk_id", "text", "doc_id", "path", "chunk_start", "chunk_end", "section_path", "pages", "page_numbers", "filename", "source_path", "mtime",
    "score", "final_score", "route", "element_ids", "bboxes", "types", "table_headers", "table_units", "source_tools",
]
#: Columns that mark a row that no profile prunes.
MARKERS = ["error", "forbidden", "abstain", "note"]


def neighbours(chunks: DataFrame, anchors: DataFrame, n: int) -> DataFrame:
    """Up to n chunks before and n + 1 from each anchor's start on, of its document, as (doc_id,
    anchor_start, chunk_start). Chunks are numbered by start within the document; anchors join by number."""
    w = Window.partitionBy("doc_id").orderBy("chunk_start")
    numbered = chunks.select("doc_id", "chunk_start").distinct().withColumn("no", F.row_number().over(w))
    at = numbered.join(anchors.select("doc_id", F.col("chunk_start").alias("anchor_start")).distinct(), "doc_id")
    first = at.groupBy("doc_id", "anchor_start").agg(F.coalesce(F.min(F.when(F.col("chunk_start") >= F.col("anchor_start"), F.col("no"))), F.max("no") + 1).alias("at"))
    near = first.select("doc_id", "anchor_start", F.explode(F.sequence(F.col("at") - n, F.col("at") + n)).alias("no"))
    return near.join(numbered, ["doc_id", "no"]).select("doc_id", "anchor_start", "chunk_start")


def near_all(chunks: DataFrame, n: int) -> DataFrame:
    """``neighbours`` with every chunk as an anchor, by numbered join: linear in chunks, however many a document has."""
    w = Window.partitionBy("doc_id").orderBy("chunk_start")
    numbered = chunks.select("doc_id", "chunk_start").distinct().withColumn("no", F.row_number().over(w))
    near = numbered.select("doc_id", F.col("chunk_start").alias("anchor_start"), F.explode(F.sequence(F.col("no") - n, F.col("no") + n)).alias("no"))
    return near.join(numbered, ["doc_id", "no"]).select("doc_id", "anchor_start", "chunk_start")


def context(chunks: DataFrame, n: int = 1) -> DataFrame:
    """Each chunk with the text of n chunks on either side as context_text, and the span that they cover."""
    w = Window.partitionBy("doc_id").orderBy("chunk_start").rowsBetween(-n, n)
    return chunks.withColumns({"context_text": F.array_join(F.collect_list("text").over(w), "\n"), "context_start": F.min("chunk_start").over(w), "context_end": F.max("chunk_end").over(w)})


def text_slice(value: Column, start: int, end: int) -> Column:
    low = max(0, start)
    return F.substring(value, low + 1, max(0, end - low))


def is_table_row(types: Column) -> Column:
    return F.exists(types, lambda t: F.lower(t) == "table_row")


def where_filter(value: Column, where: dict[str, str]) -> Column:
    """Every non-empty key and value occurs in the lower-cased text."""
    parts = [x for pair in where.items() for x in pair if x]
    out = F.lit(True)
    for x in parts:
        out = out & F.contains(F.lower(value), F.lit(x.lower()))
    return out


def allowed(rows: DataFrame, acl: DataFrame, subjects: list[str], collection_col: str = "collection", doc_col: str = "doc_id") -> DataFrame:
    """rows with ``allowed``. acl: (level, key, allow, deny), level document, collection or default.

    Document rules come first, then the collection's, then the default; in a rule deny comes before
    allow, * is everyone, and a non-empty allow without the subject denies. Without a say: allowed."""
    mine = F.array(*map(F.lit, [*subjects, "*"]))
    say = F.when(F.arrays_overlap("deny", mine), False).when(F.size("allow") > 0, F.arrays_overlap("allow", mine))
    acl = acl.select("level", "key", say.alias("say"))
    by = lambda level: acl.where(F.col("level") == level).groupBy(F.col("key").alias(f"_{level}")).agg(F.min("say").alias(f"_say_{level}"))
    out = rows.join(by("document"), F.col(doc_col).cast("string") == F.col("_document"), "left")
    out = out.join(by("collection"), F.col(collection_col) == F.col("_collection"), "left")
    out = out.crossJoin(F.broadcast(acl.where("level = 'default'").agg(F.min("say").alias("_say_default"))))
    say = F.coalesce("_say_document", "_say_collection", "_say_default", F.lit(True))
    return out.withColumn("allowed", say).drop("_document", "_collection", "_say_document", "_say_collection", "_say_default")


def under_roots(path: Column, roots: list[str]) -> Column:
    out = F.lit(not roots)
    for root in (r.rstrip("/") for r in roots):
        out = out | (path == root) | path.startswith(root + "/")
    return out


def expanded_aliases(query: Column, compat: bool = False) -> Column:
    """Phrases to OR with the query: for each abbreviation that it names, by itself or by a synonym, the
    abbreviation and its synonyms. Names match at token boundaries; compat matches them anywhere."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(query), "[^a-z0-9&]+", " "), F.lit(" "))
    names = []
    for key, synonyms in ALIASES.items():
        forms = [x.lower() for x in (key, *synonyms)]
        hit = F.lit(False)
        for x in forms:
            hit = hit | F.contains(F.lower(query) if compat else padded, F.lit(x if compat else f" {x} "))
        names.append(F.when(hit, F.array(*map(F.lit, [key, *synonyms]))).otherwise(F.array().cast("array<string>")))
    return F.flatten(F.array(*names))


def hints(buckets: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, alias) for aliases in a bucket (bucket, alias) with a seed (a column seed), case apart, without the seed itself."""
    asked = seeds.select(F.lower("seed").alias("_l")).distinct()
    found = buckets.withColumn("_l", F.lower("alias")).join(asked, "_l", "left_semi").select("bucket", F.col("alias").alias("seed"))
    return found.join(buckets, "bucket").where(F.lower("alias") != F.lower("seed")).select("seed", "alias").distinct()


def profiled(hits: DataFrame, profile: str = "slim") -> DataFrame:
    """Rows with the columns of a response profile: slim (score is final_score unless that is null or 0, else score, else 0;
    mtime as ISO 8601, null where it isn't positive), full, diagnostic (all). Columns that hits lacks stay out; an unknown profile is slim.

    Rows with a marker (error, forbidden, abstain, note) keep their markers' values; where hits has marker columns they come along."""
    if profile == "diagnostic":
        return hits
    have, out = set(hits.columns), hits
    marks = [c for c in MARKERS if c in have]
    if profile == "full":
        return out.select(*[c for c in FULL if c in have], *marks)
    if {"final_score", "score"} & have:
        final = F.nullif(F.col("final_score"), F.lit(0.0)) if "final_score" in have else F.lit(None).cast("double")
        out = out.withColumn("score", F.coalesce(final, F.col("score") if "score" in have else F.lit(None).cast("double"), F.lit(0.0)))
    if "mtime" in have:
        out = out.withColumn("mtime", F.when(F.col("mtime") > 0, F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    return out.select(*[c for c in SLIM if c in out.columns], *marks)


def as_records(rows: DataFrame) -> DataFrame:
    """(record) rows as JSON objects without their null fields."""
    return rows.select(F.to_json(F.struct("*")).alias("record"))


def opened(chunks: DataFrame, asks: DataFrame, acl: DataFrame | None = None, subjects: tuple[str, ...] = (), roots: tuple[str, ...] = ()) -> DataFrame:
    """asks (ask_id, chunk_id, element_id, start, end) answered from chunks (chunk_id, doc_id, element_ids, text and any of collection, path):
    by chunk_id, or by element_id where that is null, the first chunk by id then. (ask_id, chunk_id, doc_id, text, status): status is
    found, forbidden (by acl or the roots; no text) or not_found. start and end cut the text; null: to either end.

    Element ids reach the chunks by one explode and an equi-join, not by a search in each."""
    by_chunk = asks.where("chunk_id is not null").join(chunks, "chunk_id")
    each = chunks.select("chunk_id", F.explode("element_ids").alias("element_id")).groupBy("element_id").agg(F.min("chunk_id").alias("chunk_id"))
    by_element = asks.where("chunk_id is null and element_id is not null").drop("chunk_id").join(each, "element_id").join(chunks, "chunk_id")
    met = by_chunk.unionByName(by_element, allowMissingColumns=True)
    met = allowed(met, acl, list(subjects)) if acl is not None else met.withColumn("allowed", F.lit(True))
    may = F.col("allowed") & (under_roots(F.col("path"), list(roots)) if "path" in chunks.columns else F.lit(True))
    low = F.greatest(F.coalesce("start", F.lit(0)), F.lit(0)).cast("int")
    part = F.substr("text", low + 1, F.greatest(F.coalesce(F.col("end"), F.length("text")).cast("int") - low, F.lit(0)))
    found = met.select("ask_id", F.col("chunk_id").alias("c"), "doc_id", F.when(may, part).alias("text"), F.when(may, "found").otherwise("forbidden").alias("status"))
    out = asks.select("ask_id").join(found, "ask_id", "left")
    return out.select("ask_id", F.col("c").alias("chunk_id"), "doc_id", "text", F.coalesce("status", F.lit("not_found")).alias("status"))


def of_elements(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """(element_id, chunk_id): the first chunk (by id) that holds each element; elements in none are left out."""
    each = chunks.select("chunk_id", F.explode("element_ids").alias("element_id")).join(elements.select("element_id").distinct(), "element_id", "left_semi")
    return each.groupBy("element_id").agg(F.min("chunk_id").alias("chunk_id"))


def outline(chunks: DataFrame, doc_id=None) -> DataFrame:
    """Chunks (doc_id, chunk_start, types, text, section_path) that hold a heading, of one document or all, in order."""
    some = chunks if doc_id is None else chunks.where(F.col("doc_id") == doc_id)
    return some.where(F.exists("types", lambda t: F.contains(t, F.lit("heading")))).orderBy("doc_id", "chunk_start")


def why_rows(tokens: Column, value: Column, section: Column, types: Column, elements: Column, limit: int = 6) -> Column:
    """struct(terms, sections, table, element): matched terms, section segments that hold any query term, whether it is a table row and then its first element."""
    low = F.filter(section, lambda s: F.exists(tokens, lambda t: F.contains(F.lower(s), t)))
    table = is_table_row(types)
    return F.struct(why(tokens, value, limit).alias("terms"), low.alias("sections"), table.alias("table"), F.when(table, F.get(elements, F.lit(0))).alias("element"))


def why(tokens: Column, value: Column, limit: int = 6) -> Column:
    """Sorted distinct query tokens that the text holds, at most limit."""
    return F.slice(F.array_sort(F.filter(F.array_distinct(tokens), lambda t: F.contains(F.lower(value), t))), 1, limit)


