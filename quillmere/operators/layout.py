"""Blocks from page layouts and plain text: element ids, units, OCR need, previews, content and plan hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import chunking

#: A block: the schema that layouts and chunkers share.
BLOCK = (
    "doc_id long, block long, page int, kind string, text string, section_path array<string>, element_id string, "
    "bbox array<double>, headers array<string>, units map<string,string>, source_tool string"
)
KINDS = {"section_header": "heading", "title": "heading", "heading": "heading"}
PARTS = ("cells", "texts", "captions", "pictures")


def element_ids(prefix: Column, page: Column, number: Column) -> Column:
    """prefix_page_number; number counts a document's elements of the prefix."""
    return F.concat_ws("_", prefix, page.cast("string"), number.cast("string"))


def units_map(headers: Column) -> Column:
    """{name: unit} of headers "name (unit)"; of equal names the last."""
    pattern = r"^(.+?)\s*\(([^)]+)\)$"
    pairs = F.transform(
        F.filter(headers, lambda h: F.trim(h).rlike(pattern)),
        lambda h: F.struct(F.trim(F.regexp_extract(F.trim(h), pattern, 1)).alias("name"), F.trim(F.regexp_extract(F.trim(h), pattern, 2)).alias("unit")),
    )
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, 1_000_000), lambda y: y["name"] == x["name"]))
    return F.map_from_entries(last)


def header_units(headers: Column) -> Column:
    """{name: unit} of headers that have a unit by any of ``header_unit``'s rules; of equal names the last."""
    made = F.filter(F.transform(headers, chunking.header_unit), lambda x: x["unit"].isNotNull())
    last = F.filter(made, lambda x, i: ~F.exists(F.slice(made, i + 2, 1_000_000), lambda y: y["name"] == x["name"]))
    return F.map_from_entries(last)


def needs_ocr(pages: Column, least: int = 100) -> Column:
    """Whether the texts of the first, middle and last page, and of the quarter points where there are more than 10,
    hold fewer than least characters on average, white space at their ends apart; true without pages."""
    n = F.size(pages)
    picks = F.array_distinct(F.when(n > 10, F.array(F.lit(0), F.floor(n / 4).cast("int"), F.floor(n / 2).cast("int"), F.floor(3 * n / 4).cast("int"), n - 1)).when(n > 2, F.array(F.lit(0), F.floor(n / 2).cast("int"), n - 1)).otherwise(F.array(F.lit(0), n - 1)))
    chars = F.aggregate(picks, F.lit(0).cast("long"), lambda a, i: a + F.coalesce(F.length(F.regexp_replace(F.get(pages, i), r"^\s+|\s+$", "")), F.lit(0)))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, True).otherwise(chars / F.size(picks) < least)


def layout_blocks(cells: DataFrame, texts: DataFrame, captions: DataFrame, pictures: DataFrame, tool: str = "layout") -> DataFrame:
    """Blocks (BLOCK's columns) of documents' layouts, in page order and on a page in the order of its table rows, texts, captions,
    pictures.

    cells: doc_id, page, item (the table's number), row, col, text, bbox [left, top, right, bottom]; row 0 holds the headers.
    texts, captions: doc_id, page, item, label, text, bbox. pictures: doc_id, page, item, bbox. A table row is "header: value; ..." of
    its cells with text and has the union of their boxes. Headings update the section path of all that follows;
    rows of null pages and texts of white space only are left out. One document's headings are folded in one row."""
    heads = cells.where("row = 0").groupBy("doc_id", "page", "item").agg(F.array_sort(F.collect_list(F.struct("col", F.trim("text").alias("text")))).alias("h"))
    body = cells.where("row > 0 and page is not null and trim(text) <> ''").groupBy("doc_id", "page", "item", "row").agg(
        F.array_sort(F.collect_list(F.struct("col", F.trim("text").alias("text")))).alias("c"), *[f(F.get("bbox", F.lit(i))).alias(f"b{i}") for i, f in enumerate((F.min, F.min, F.max, F.max))]
    )
    body = body.join(heads, ["doc_id", "page", "item"], "left").withColumn("h", F.coalesce("h", F.array().cast("array<struct<col:int,text:string>>")))
    named = lambda c: F.coalesce(F.get(F.transform(F.filter("h", lambda x: x["col"] == c["col"]), lambda x: x["text"]), F.lit(0)), F.concat(F.lit("col_"), c["col"].cast("string")))
    rows = body.select(
        "doc_id", "page", F.lit(0).alias("part"), "item", F.col("row").cast("long").alias("sub"), F.lit("table_row").alias("kind"),
        F.array_join(F.transform("c", lambda c: F.concat(named(c), F.lit(": "), c["text"])), "; ").alias("text"),
        F.when(F.col("b0").isNotNull(), F.array("b0", "b1", "b2", "b3")).alias("bbox"), F.transform("h", lambda x: x["text"]).alias("headers"), header_units(F.transform("c", named)).alias("units"),
    )
    none = {"headers": F.lit(None).cast("array<string>"), "units": F.lit(None).cast("map<string,string>"), "sub": F.lit(0).cast("long")}
    label = F.coalesce("label", F.lit("text"))
    kind = F.when(label.isin(*KINDS), "heading").when(F.contains(label, F.lit("list")), "list").otherwise("para")
    plain = texts.where("page is not null and trim(text) <> ''").select("doc_id", "page", F.lit(1).alias("part"), "item", kind.alias("kind"), F.trim("text").alias("text"), "bbox").withColumns(none)
    told = captions.where("page is not null and trim(text) <> ''").select("doc_id", "page", F.lit(2).alias("part"), "item", F.lit("caption").alias("kind"), F.trim("text").alias("text"), "bbox").withColumns(none)
    shown = pictures.where("page is not null").select("doc_id", "page", F.lit(3).alias("part"), "item", F.lit("figure").alias("kind"), F.lit("").alias("text"), "bbox").withColumns(none)
    out = rows.unionByName(plain).unionByName(told).unionByName(shown)
    order = Window.partitionBy("doc_id").orderBy("page", "part", "item", "sub")
    number = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("page", "part", "item", "sub"))
    out = out.withColumns({"block": (F.row_number().over(order) - 1).cast("long"), "element_id": element_ids(F.col("kind"), F.col("page"), number)})
    return with_paths(out).withColumn("source_tool", F.lit(tool)).select(*[x.split()[0] for x in BLOCK.split(", ")])


def with_paths(blocks: DataFrame, id_col: str = "doc_id", level: Column | None = None) -> DataFrame:
    """blocks (id, block, kind, text) with section_path: the path of headings up to and with the block. level is a heading's
    own, by default inferred from its title. Only headings are gathered, in runs before each block."""
    level = chunking.inferred_level(F.col("text")) if level is None else level
    before = Window.partitionBy(id_col).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    run = blocks.withColumn("_h", F.sum((F.col("kind") == "heading").cast("int")).over(before))
    heads = run.where("kind = 'heading'").select(id_col, "_h", F.struct(level.cast("int").alias("level"), F.trim("text").alias("title")).alias("x"))
    w = Window.partitionBy(id_col).orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    paths = heads.select(id_col, "_h", chunking.section_path(F.collect_list("x").over(w)).alias("section_path"))
    return run.join(paths, [id_col, "_h"], "left").drop("_h").withColumn("section_path", F.coalesce("section_path", F.array().cast("array<string>")))


def content_hash(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, content_hash): SHA-256 of a document's block texts in order, joined by line feeds."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    return blocks.groupBy(id_col).agg(F.sha2(F.array_join(texts, "\n"), 256).alias("content_hash"))


def previews(chunks: DataFrame, id_col: str = "doc_id", order: str = "chunk_start", limit: int = 8, chars: int = 280) -> DataFrame:
    """(id, index, length, preview) of each document's first limit chunks."""
    w = Window.partitionBy(id_col).orderBy(order)
    out = chunks.withColumn("index", F.row_number().over(w) - 1).where(F.col("index") < limit)
    return out.select(id_col, "index", F.length("text").alias("length"), F.substring("text", 1, chars).alias("preview"))


def plan_hash(**fields: Column) -> Column:
    """SHA-256 of an object with sorted keys; a plan_hash among them plays no part, so hashing again gives the same. Nulls have no key."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields) if k != "plan_hash"])), 256)


def metadata_verdict(metadata: Column, calls: Column, max_bytes: int = 8192, max_calls: int = 2) -> Column:
    """null, or why a document's metadata (a struct) is refused: the call budget is used up, or its JSON is too long in UTF-8."""
    size = F.octet_length(F.to_json(metadata))
    return F.when(calls >= max_calls, F.lit("metadata_budget_exceeded")).when(size > max_bytes, F.concat(F.lit("metadata_bytes_exceeded:"), size.cast("string"), F.lit(f">{max_bytes}")))


def collected_units(chunks: DataFrame, id_col: str = "doc_id", order: str = "chunk_start", limit: int = 16) -> DataFrame:
    """(id, units): the first limit distinct units of a document's chunks (units array<string>) in the order of their coming."""
    each = chunks.select(id_col, order, F.posexplode("units").alias("pos", "unit")).withColumn("unit", F.trim("unit")).where("unit <> ''")
    first = each.groupBy(id_col, "unit").agg(F.min(F.struct(order, "pos")).alias("at"))
    return first.groupBy(id_col).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "unit"))), lambda x: x["unit"]), 1, limit).alias("units"))





def fold_text(blocks: list[dict], max_chars: int, overlap: int) -> list[dict]:
    """Chunks of a plain text from its ordered blocks (kind, level, lines, start, end): paragraphs and lists gather up
    to max_chars and carry their last overlap characters on; headings only set the path; each row of a parsable table is a chunk."""
    out, path, held, tables = [], [], [], 0

    def flush() -> None:
        nonlocal held
        made = "\n\n".join(h["text"] for h in held).strip()
        if made:
            start, end = held[0]["start"], held[-1]["end"]
            kind = "list" if any(h["kind"] == "list" for h in held) else "paragraph"
            out.append({"start": start, "end": end, "text": made, "kind": kind, "section_path": list(path)})
            held = [{"text": made[-overlap:], "start": max(end - overlap, start), "end": end, "kind": kind}] if 0 < overlap < len(made) else []
        else:
            held = []

    for block in blocks:
        if block["kind"] == "heading":
            flush()
            title = re.sub(r"^(#{1,6}|(?:\d+\.)*\d+)\s+", "", block["lines"][0].strip())
            path = [*path[: max(0, int(block["level"] or 1) - 1)], title]
            continue
        if block["kind"] == "table":
            flush()
            tables += 1
            rows = block["rows"]
            if rows is not None and len(rows):
                out += [{"start": block["start"], "end": block["end"], "text": row, "kind": "table_row", "section_path": list(path)} for row in rows]
                continue
        body = "\n".join(block["lines"]).strip()
        if body:
            held.append({"text": body, "start": block["start"], "end": block["end"], "kind": block["kind"]})
            if sum(len(h["text"]) + 2 for h in held) - 2 >= max_chars:
                flush()
    flush()
    return out


def text_chunks(docs: DataFrame, max_chars: int = 900, overlap: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk, start, end, text, kind, section_path) of plain texts, by ``fold_text``, each text where it is."""
    if max_chars <= 0:
        raise ValueError("max_chars must be positive")
    return chunking.of_texts(docs, lambda t: fold_text(chunking.text_blocks(t), max_chars, overlap), "start long, end long, text string, kind string, section_path array<string>", id_col, text_col)
