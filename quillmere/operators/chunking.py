"""Lines, blocks, tables, headers and chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Markers of headings, list items and table rules.
HEADING_MD = r"^(#{1,6})\s+(.+)$"
HEADING_NUM = r"^((?:\d+\.)*\d+)\s+(.+)$"
LIST_ITEM = r"^(\*|-|\+|\d+[.)])\s+"
#: Units that a header may end in.
UNITS = (
    "m mm cm km g kg mg L mL s min h hr A V W kW MW Pa kPa MPa bar psi psig N kN J kJ MJ °C °F K degC degF m³ m3 gal ft³ ft3 GPM gpm LPM lpm "
    "m³/h m3/h L/s m³/s m3/s mg/L g/L ppm ppb % wt% vol% m/s ft/s mph km/h rpm Hz kHz MHz Ω ohm mol mmol μm nm"
).split()


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, line, start, end) with character offsets; a text that ends in a line feed has an empty last line."""
    parts = F.split(F.col(text_col), "\n")
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    out = docs.select(id_col, F.posexplode(parts).alias("pos", "line"))
    out = out.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).cast("long"))
    return out.withColumn("end", F.col("start") + F.length("line"))


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, block, lines array, start, end, kind, level): runs of lines that aren't blank, classified."""
    w = Window.partitionBy(id_col).orderBy("pos")
    out = lines(docs, id_col, text_col).withColumn("blank", F.trim("line") == "")
    out = out.withColumn("gap", F.sum(F.col("blank").cast("int")).over(w)).where(~F.col("blank"))
    out = out.groupBy(id_col, "gap").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("x"), F.min("start").alias("start"), F.max("end").alias("end"))
    out = out.withColumn("lines", F.col("x.line")).withColumn("block", F.row_number().over(Window.partitionBy(id_col).orderBy("gap")) - 1)
    return out.select(id_col, "block", "lines", "start", "end", block_kind(F.col("lines")).alias("kind"), heading_level(F.col("lines")).alias("level"))


def is_table(rows: Column) -> Column:
    """Two lines or more, of which half, and at least two, hold pipes, or tabs."""
    least = F.greatest(F.lit(2), F.floor(F.size(rows) / 2))
    count = lambda mark: F.size(F.filter(rows, lambda x: F.contains(x, F.lit(mark))))
    return (F.size(rows) >= 2) & ((count("|") >= least) | (count("\t") >= least))


#: Java's $ and dot: a text ends before one last line terminator, which a dot never is.
_END, _ANY = r"(?=(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z)", r"[^\n\r\u0085\u2028\u2029]"
_MD, _NUM, _ITEM = (re.compile(x.replace("(.+)$", f"({_ANY}+){_END}"), re.ASCII) for x in (HEADING_MD, HEADING_NUM, LIST_ITEM))
_RULE, _PIPES = re.compile(rf"\s*[:|\- ]+\s*{_END}", re.ASCII), re.compile(rf"\A\||\|{_END}")


def text_blocks(text: str) -> list[dict]:
    """``blocks`` of one text where it is: dicts of lines, start, end, kind, level, and rows (``table_rows``) of tables."""
    out, held, start, at = [], [], 0, 0
    for line in [*text.split("\n"), ""]:
        if line.strip(" "):
            if not held:
                start = at
            held.append(line)
        elif held:
            out.append({"lines": held, "start": start, "end": at - 1, **_kind(held)})
            held = []
        at += len(line) + 1
    return out


def _kind(lines: list[str]) -> dict:
    first = lines[0].strip(" ")
    if found := _MD.match(first):
        return {"kind": "heading", "level": len(found[1]), "rows": None}
    if len(lines) == 1 and (found := _NUM.match(first)):
        return {"kind": "heading", "level": min(6, found[1].count(".") + 1), "rows": None}
    if all(_ITEM.match(x.strip(" ")) for x in lines):
        return {"kind": "list", "level": None, "rows": None}
    least = max(2, len(lines) // 2)
    if len(lines) < 2 or max(sum("|" in x for x in lines), sum("\t" in x for x in lines)) < least:
        return {"kind": "para", "level": None, "rows": None}
    cells = [[c.strip(" ") for c in _PIPES.sub("", x.strip(" ")).split("|")] for x in lines]
    body = [c for c in cells[2 if _RULE.match(lines[1]) else 1 :] if len(c) == len(cells[0])]
    made = ["; ".join(f"{h}: {v}" for h, v in zip(cells[0], c, strict=True)) for c in body]
    return {"kind": "table", "level": None, "rows": made if len(cells[0]) >= 2 and made else None}


def of_texts(docs: DataFrame, fold: Callable[[str], list[dict]], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk and the schema's columns): what fold makes of each text, a text at a time where it is; nulls have none."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [{id_col: doc, "chunk": i, **x} for i, x in enumerate(fold(text))]
                if len(rows) >= 4096:
                    yield made(rows)
                    rows = []
        if rows:
            yield made(rows)

    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64()}

    def kind(name: str) -> pa.DataType:
        return pa.list_(kind(name[6:-1])) if name.startswith("array<") else kinds[name]

    arrow = pa.schema([(id_col, pa.int64()), ("chunk", pa.int64()), *((n, kind(x.split()[1])) for n, x in zip(names, schema.split(", "), strict=True))])

    def made(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=arrow)

    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), text_col).mapInArrow(run, f"{id_col} long, chunk long, {schema}")


def block_kind(rows: Column) -> Column:
    first = F.trim(F.element_at(rows, 1))
    return (
        F.when(first.rlike(HEADING_MD), "heading")
        .when((F.size(rows) == 1) & first.rlike(HEADING_NUM), "heading")
        .when(F.forall(rows, lambda x: F.trim(x).rlike(LIST_ITEM)), "list")
        .when(is_table(rows), "table")
        .otherwise("para")
    )


def heading_level(rows: Column) -> Column:
    """Number of # or dots + 1, at most 6; null for what is no heading."""
    first = F.trim(F.element_at(rows, 1))
    dots = F.length(F.regexp_replace(F.regexp_extract(first, HEADING_NUM, 1), r"[^.]", ""))
    return F.when(first.rlike(HEADING_MD), F.length(F.regexp_extract(first, HEADING_MD, 1))).when((F.size(rows) == 1) & first.rlike(HEADING_NUM), F.least(F.lit(6), dots + 1))


def inferred_level(title: Column) -> Column:
    """Level of an extracted heading: depth of its number, else 2 if upper case, else 1."""
    number = F.regexp_extract(title, r"^\s*(\d+(?:\.\d+)*)", 1)
    return F.when(number != "", F.least(F.lit(6), F.size(F.split(number, r"\.")))).when((F.upper(title) == title) & title.rlike("[A-Z]"), 2).otherwise(1)


def section_path(headings: Column) -> Column:
    """Path after an ordered array of struct(level, title): each pops what is as deep or deeper, then goes on top."""
    return F.aggregate(
        headings,
        F.array().cast("array<string>"),
        lambda path, h: F.concat(F.slice(path, 1, F.least(F.size(path), F.greatest(F.lit(1), F.least(F.lit(6), h["level"])) - 1)), F.array(h["title"])),
    )


def table_rows(rows: Column) -> Column:
    """Array of "header: value; ..." for each data row of a pipe table; rows with another number of cells are
    left out; null unless there are two headers and a data row."""
    cells = F.transform(rows, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))
    head = F.element_at(cells, 1)
    rule = F.element_at(rows, 2).rlike(r"^\s*[:|\- ]+\s*$")
    body = F.filter(F.slice(cells, F.when(rule, 3).otherwise(2), F.size(cells)), lambda c: F.size(c) == F.size(head))
    made = F.transform(body, lambda c: F.array_join(F.zip_with(head, c, lambda h, v: F.concat(h, F.lit(": "), v)), "; "))
    return F.when((F.size(head) >= 2) & (F.size(body) >= 1), made)


def header_unit(header: Column) -> Column:
    """struct(name, unit): "name (unit)", "name [unit]", "name, unit" for a short unit, "name unit" for a known one."""
    h = F.trim(header)
    out = F.lit(None).cast("struct<name:string,unit:string>")
    made = lambda pattern: F.struct(F.trim(F.regexp_extract(h, pattern, 1)).alias("name"), F.trim(F.regexp_extract(h, pattern, 2)).alias("unit"))
    paren, square, comma, tail = r"^(.+?)\s*\(([^)]+)\)$", r"^(.+?)\s*\[([^\]]+)\]$", r"^(.+?)\s*,\s*(.+)$", r"^(.*\S)\s+(\S+)$"
    unit = F.trim(F.regexp_extract(h, comma, 2))
    last = F.regexp_extract(h, tail, 2)
    known = last.isin(UNITS) | F.replace(last, F.lit("³"), F.lit("3")).isin(UNITS)
    out = F.when(h.rlike(paren), made(paren)).when(h.rlike(square), made(square))
    out = out.when(h.rlike(comma) & (F.length(unit) <= 20) & ~unit.rlike(r"\s+[a-z]{5,}"), made(comma)).when(h.rlike(tail) & known, made(tail))
    return out.otherwise(F.struct(h.alias("name"), F.lit(None).cast("string").alias("unit")))


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1800, overlap: int = 150) -> DataFrame:
    """(doc_id, chunk_start, chunk_end, text): fixed windows; the last is the first that reaches the end;
    windows of white space only are left out. An overlap of size or more becomes a quarter of it."""
    overlap = overlap if overlap < size else size // 4
    step = size - overlap
    n = F.length(text_col)
    out = docs.where(n > 0).select(id_col, text_col, n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(step))).alias("i"))
    out = out.where((F.col("i") == 0) | (F.col("i") - step + size < F.col("n")))
    out = out.select(id_col, F.col("i").cast("long").alias("chunk_start"), F.least(F.col("i") + size, F.col("n")).cast("long").alias("chunk_end"), F.substring(text_col, F.col("i") + 1, F.lit(size)).alias("text"))
    return out.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")


def profile(counted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, profile) from blocks (doc_id, kind, text): table_row, procedure_block, or heading_based."""
    step = ((F.col("kind") == "list") & (F.trim("text") != "")) | F.trim("text").rlike(r"^\d+(?:\.\d+)*\s")
    agg = counted.groupBy(id_col).agg(F.count("*").alias("n"), F.sum((F.col("kind") == "table_row").cast("int")).alias("rows"), F.sum(F.coalesce(step.cast("int"), F.lit(0))).alias("steps"))
    least = F.greatest(F.lit(3), F.floor(F.col("n") / 4))
    return agg.select(id_col, F.when(F.col("rows") > 0, "table_row").when((F.col("steps") > 0) & (F.col("steps") >= least), "procedure_block").otherwise("heading_based").alias("profile"))


def profiles(docs: DataFrame, counted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``profile`` for every document of docs; one without blocks has fixed_window."""
    return docs.select(id_col).distinct().join(profile(counted, id_col), id_col, "left").withColumn("profile", F.coalesce("profile", F.lit("fixed_window")))


SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: What a chunk keeps of its blocks, besides text, types and section path; a block may lack any of them.
KEPT = {"page": "pages", "element_id": "element_ids", "bbox": "bboxes", "source_tool": "source_tools", "headers": "headers", "units": "units"}


def _lists(value) -> list[str]:
    """Strings of a block's headers or units: a list, a map's values, or one."""
    if value is None:
        return []
    items = value.values() if isinstance(value, dict) else [value] if isinstance(value, str) else [v[1] if isinstance(v, tuple) else v for v in value]
    return [str(x).strip() for x in items if x]


def fold_blocks(rows: list[dict], max_chars: int = 900, overlap_sentences: int = 1, profile_name: str = "heading_based", compat: bool = False) -> list[dict]:
    """Chunks of one document's ordered blocks (kind, text, section_path and any of KEPT). Blocks are never split; a heading is
    a chunk of its own except under fixed_window; under table_row each row is one. A chunk carries the last
    sentences of the one before; chunks that hold only such an overlap are left out unless compat."""
    if max_chars <= 0:
        raise ValueError("max_chars must be positive")
    overlap = 0 if profile_name == "fixed_window" else overlap_sentences
    out, held, carried, cursor = [], [], False, 0

    def emit(parts: list[dict]) -> str:
        nonlocal cursor
        text = "\n\n".join(p["text"] for p in parts if p["text"])
        if text.strip():
            out.append({
                "text": text,
                "types": [p["kind"] for p in parts],
                "section_path": parts[-1]["section_path"],
                "chunk_start": cursor,
                "chunk_end": cursor + len(text),
                "pages": sorted({int(p["page"]) for p in parts if p.get("page") is not None and p["page"] == p["page"]}),
                "element_ids": [p["element_id"] for p in parts if p.get("element_id")],
                "bboxes": [list(p["bbox"]) for p in parts if p.get("bbox") is not None],
                "source_tools": sorted({p["source_tool"] for p in parts if p.get("source_tool")}),
                "headers": [x for p in parts for x in _lists(p.get("headers"))],
                "units": [x for p in parts for x in _lists(p.get("units"))],
            })
            cursor += len(text)
        return text

    def flush() -> None:
        nonlocal held, carried
        if held and (compat or not (carried and not any(h["text"] for h in held[1:]))):
            text = emit(held)
            last = [s for s in SENTENCE.split(text) if s.strip()][-overlap:] if overlap else []
            tail = " ".join(last)
            kept = {k: held[-1].get(k) for k in ("page", "source_tool")}
            held, carried = ([{"kind": "para", "text": tail, "section_path": held[-1]["section_path"], **kept}], True) if tail else ([], False)
        else:
            held, carried = [], False

    for row in rows:
        row = {**row, "text": row["text"] or "", "section_path": [] if row["section_path"] is None else list(row["section_path"])}
        if profile_name == "table_row" and row["kind"] == "table_row":
            flush()
            if not compat:
                held, carried = [], False
            emit([row])
        elif profile_name != "fixed_window" and row["kind"] == "heading":
            flush()
            held, carried = [], False
            emit([row])
        else:
            held.append(row)
            if sum(len(x["text"]) for x in held) >= max_chars:
                flush()
    flush()
    return out


CHUNK = (
    "chunk long, text string, types array<string>, section_path array<string>, chunk_start long, chunk_end long, pages array<int>, element_ids array<string>, "
    "bboxes array<array<double>>, source_tools array<string>, headers array<string>, units array<string>"
)


def structured_chunks(table: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, chunk and CHUNK's other columns, profile) from blocks (doc_id, block, kind, text, section_path, any of KEPT, profile). Without a column
    profile, options' profile_name holds for all. The fold is sequential within a document, which one task holds; documents are
    spread by their id."""
    names = [x.split()[0] for x in CHUNK.split(", ")]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        chosen = dict(options)
        if "profile" in rows.columns:
            chosen["profile_name"] = rows["profile"].iloc[0]
        found = fold_blocks(rows.sort_values("block").to_dict("records"), **chosen)
        made = [{id_col: key[0], "chunk": i, **x, "profile": chosen.get("profile_name", "heading_based")} for i, x in enumerate(found)]
        return pd.DataFrame(made, columns=[id_col, *names, "profile"])

    kept = [c for c in ("block", "kind", "text", "section_path", *KEPT, "profile") if c in table.columns]
    return table.select(id_col, *kept).groupBy(id_col).applyInPandas(run, f"{id_col} long, {CHUNK}, profile string")


_STEP = re.compile(r"\d+(?:\.\d+)*\s", re.ASCII)


def text_fold(text: str, max_chars: int) -> list[dict]:
    """``fold_blocks`` of a plain text's blocks, with the section paths, element ids and profile that ``ingest.ingested`` gives them."""
    rows, path, numbers, steps = [], [], {}, 0
    for i, x in enumerate(text_blocks(text)):
        kind, said = x["kind"], "\n".join(x["lines"])
        if kind == "heading":
            path = [*path[: max(1, min(6, x["level"])) - 1], said.strip(" ")]
        numbers[kind] = numbers.get(kind, 0) + 1
        steps += kind == "list" or _STEP.match(said.strip(" ")) is not None
        rows.append({"block": i, "kind": kind, "text": said, "section_path": path, "element_id": f"{kind}_1_{numbers[kind]}"})
    name = "procedure_block" if steps and steps >= max(3, len(rows) // 4) else "heading_based"
    return [{**x, "profile": name} for x in fold_blocks(rows, max_chars=max_chars, profile_name=name)]


def text_folds(docs: DataFrame, max_chars: int = 900) -> DataFrame:
    """``structured_chunks`` of plain texts (doc_id, text), each folded where it is."""
    if max_chars <= 0:
        raise ValueError("max_chars must be positive")
    return of_texts(docs, lambda t: text_fold(t, max_chars), f"{CHUNK.removeprefix('chunk long, ')}, profile string")


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, block, kind, text) from headings, paragraphs, list items and table rows of HTML, by
    expressions only: raw elements and comments go, each start tag of a block begins one."""
    bare = F.regexp_replace(F.col(html_col), r"(?is)<!--.*?-->|<(script|style|noscript|title|nav|footer)\b.*?</\1\s*>", " ")
    parts = F.split(bare, r"(?i)(?=<(?:h[1-6]|p|li|tr|article|div|ul)\b)")
    out = pages.select(id_col, F.posexplode(parts).alias("block", "x"))
    tag = F.lower(F.regexp_extract("x", r"^<([a-zA-Z0-9]+)", 1))
    plain = F.trim(F.regexp_replace(F.regexp_replace("x", r"<[^>]*>", " "), r"\s+", " "))
    for code, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(code), F.lit(mark))
    kind = F.when(tag.rlike("^h[1-6]$"), "heading").when(tag == "li", "list").when(tag == "tr", "table_row").otherwise("para")
    return out.select(id_col, F.col("block").cast("long"), kind.alias("kind"), plain.alias("text")).where("text <> ''")
