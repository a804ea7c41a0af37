"""Registered queries over structured text: documents, and a Markdown sheet for each part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, graph, layout
from .search import query, table

_SHEET = """'# ' || p_name || chr(10) || chr(10) || '1.' || p_size || ' ' || p_type || chr(10) || chr(10) || 'First of ' || p_brand || '.' || chr(10) || 'Second line.' || chr(10) || chr(10)
|| '- a' || chr(10) || '- ' || p_brand || chr(10) || chr(10) || '| size (cm) | price [usd] |' || chr(10) || '|---|---|' || chr(10) || '| ' || p_size || ' | ' || p_partkey || ' |' || chr(10) || '| odd |' || chr(10) || '| x | y |'"""


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of all parts, as negative ids, and of all documents."""
    sheets = table(spark, sf_dir, "part").select((-1 - F.col("p_partkey")).alias("doc_id"), F.expr(_SHEET).alias("text"))
    return sheets.unionByName(table(spark, sf_dir, "documents").select("doc_id", "text"))


_BLOCKS = f"""t AS (SELECT -1 - p_partkey AS doc_id, {_SHEET} AS text FROM part UNION ALL SELECT doc_id, text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM t WHERE text IS NOT NULL),
g AS (SELECT *, sum(CASE WHEN trim(line, ' ') = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM l),
b AS (SELECT doc_id, gap, list(line ORDER BY pos) AS x FROM g WHERE trim(line, ' ') <> '' GROUP BY ALL),
m AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY gap) - 1 AS block, x, trim(x[1], ' ') AS f FROM b),
blocks AS (SELECT doc_id, block, x, f, array_to_string(x, chr(10)) AS text,
  CASE WHEN regexp_matches(f, '^(#{{1,6}})\\s+(.+)$') THEN 'heading' WHEN len(x) = 1 AND regexp_matches(f, '^((?:\\d+\\.)*\\d+)\\s+(.+)$') THEN 'heading'
    WHEN len(list_filter(x, lambda y: NOT regexp_matches(trim(y, ' '), '^(\\*|-|\\+|\\d+[.)])\\s+'))) = 0 THEN 'list'
    WHEN len(x) >= 2 AND (len(list_filter(x, lambda y: contains(y, '|'))) >= greatest(2, len(x) // 2) OR len(list_filter(x, lambda y: contains(y, chr(9)))) >= greatest(2, len(x) // 2)) THEN 'table' ELSE 'para' END AS kind,
  CASE WHEN regexp_matches(f, '^(#{{1,6}})\\s+(.+)$') THEN length(regexp_extract(f, '^(#{{1,6}})', 1))
    WHEN len(x) = 1 AND regexp_matches(f, '^((?:\\d+\\.)*\\d+)\\s+(.+)$') THEN least(6, 1 + length(regexp_replace(regexp_extract(f, '^((?:\\d+\\.)*\\d+)', 1), '[^.]', '', 'g'))) END AS level FROM m)"""


@query(f"WITH {_BLOCKS} SELECT doc_id, block::INTEGER AS block, kind, level::INTEGER AS level, md5(text) AS text_md5 FROM blocks")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.blocks(_sheets(spark, sf_dir)).select("doc_id", F.col("block").cast("int"), "kind", "level", F.md5(F.encode(F.array_join("lines", "\n"), "UTF-8")).alias("text_md5"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.blocks(_sheets(spark, sf_dir)).select("doc_id", "block", "kind", "level", F.array_join("lines", "\n").alias("text"))


@query(
    f"""WITH {_BLOCKS}, c AS (SELECT doc_id, x, list_transform(x, lambda r: list_transform(string_split(regexp_replace(trim(r, ' '), '^\\||\\|$', '', 'g'), '|'), lambda v: trim(v, ' '))) AS cells FROM blocks WHERE kind = 'table'),
h AS (SELECT doc_id, cells[1] AS head, list_filter(cells[CASE WHEN regexp_matches(x[2], '^\\s*[:|\\- ]+\\s*$') THEN 3 ELSE 2 END:], lambda r: len(r) = len(cells[1])) AS body FROM c)
SELECT doc_id, unnest(list_transform(body, lambda r: array_to_string(list_transform(range(1, len(r) + 1), lambda i: head[i] || ': ' || r[i]), '; '))) AS line FROM h WHERE len(head) >= 2 AND len(body) >= 1"""
)
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.blocks(_sheets(spark, sf_dir)).where("kind = 'table'")
    return found.select("doc_id", F.explode(chunking.table_rows(F.col("lines"))).alias("line"))


@query(
    f"""WITH {_BLOCKS}, p AS (SELECT doc_id, block, kind, text, level, count(*) FILTER (WHERE kind = 'heading') OVER (PARTITION BY doc_id ORDER BY block) AS h FROM blocks)
SELECT doc_id, block::INTEGER AS block, CASE WHEN doc_id >= 0 THEN '' WHEN h = 1 THEN (SELECT '# ' || p_name FROM part WHERE -1 - p_partkey = doc_id) ELSE (SELECT '# ' || p_name || ' > 1.' || p_size || ' ' || p_type FROM part WHERE -1 - p_partkey = doc_id) END AS path
FROM p WHERE doc_id < 0 OR h = 0"""
)
def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of every block of the sheets, and of documents' blocks before any heading."""
    rows = layout.with_paths(_blocks(spark, sf_dir), level=F.col("level"))
    return rows.where("doc_id < 0 or size(section_path) = 0").select("doc_id", F.col("block").cast("int"), F.array_join("section_path", " > ").alias("path"))


@query(
    f"""WITH {_BLOCKS} SELECT doc_id, block::INTEGER AS block, text, (CASE WHEN regexp_matches(text, '^\\s*\\d') THEN least(6, 1 + length(regexp_replace(regexp_extract(text, '^\\s*(\\d+(?:\\.\\d+)*)', 1), '[^.]', '', 'g')))
WHEN upper(text) = text AND regexp_matches(text, '[A-Z]') THEN 2 ELSE 1 END)::INTEGER AS level FROM blocks WHERE kind = 'heading'"""
)
def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocks(spark, sf_dir).where("kind = 'heading'")
    return rows.select("doc_id", F.col("block").cast("int"), "text", chunking.inferred_level(F.col("text")).cast("int").alias("level"))


@query(
    f"""WITH {_BLOCKS}, s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE (kind = 'list' AND trim(text, ' ') <> '') OR regexp_matches(trim(text, ' '), '^\\d+(?:\\.\\d+)*\\s')) AS steps FROM blocks GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN n IS NULL THEN 'fixed_window' WHEN steps > 0 AND steps >= greatest(3, n // 4) THEN 'procedure_block' ELSE 'heading_based' END AS profile FROM (SELECT DISTINCT doc_id FROM t) t LEFT JOIN s USING (doc_id)"""
)
def chunk_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _sheets(spark, sf_dir)
    return chunking.profiles(docs, _blocks(spark, sf_dir))


@query(f"WITH {_BLOCKS} SELECT doc_id, sha256(string_agg(text, chr(10) ORDER BY block)) AS content_hash FROM blocks GROUP BY doc_id")
def block_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.content_hash(_blocks(spark, sf_dir))


_HEADERS = ["p_name || ' (' || p_size || ' m3/h)'", "p_name || ' [mg/L]'", "p_name || ', °C'", "p_name || ' m³/h'", "p_name || ', which is verylong'", "p_name"]
_CASE = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_HEADERS)) + " END"


@query(
    f"""SELECT p_partkey, {_CASE} AS header, CASE p_partkey % 6 WHEN 4 THEN p_name || ', which is verylong' ELSE p_name END AS name,
CASE p_partkey % 6 WHEN 0 THEN p_size || ' m3/h' WHEN 1 THEN 'mg/L' WHEN 2 THEN '°C' WHEN 3 THEN 'm³/h' END AS unit FROM part"""
)
def header_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_CASE).alias("header"))
    return rows.select("p_partkey", "header", chunking.header_unit(F.col("header")).alias("x")).select("p_partkey", "header", "x.name", "x.unit")


@query("SELECT p_partkey, p_name || '=' || CASE WHEN p_size % 2 = 0 THEN 'kg' ELSE 'cm' END || ';' || p_type || '=' || p_size AS units FROM part WHERE p_name <> p_type")
def units_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of which one name comes twice: its last unit stays."""
    unit = F.when(F.col("p_size") % 2 == 0, "kg").otherwise("cm")
    paren = lambda name, u: F.concat(name, F.lit(" ("), u, F.lit(")"))
    headers = F.array(paren(F.col("p_name"), F.lit("m")), F.col("p_brand"), paren(F.col("p_name"), unit), paren(F.col("p_type"), F.col("p_size").cast("string")))
    rows = table(spark, sf_dir, "part").where("p_name <> p_type").select("p_partkey", layout.units_map(headers).alias("m"))
    said = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("p_partkey", F.array_join(said, ";").alias("units"))


@query(
    """WITH c AS (SELECT p_partkey AS doc_id, 'table_row' AS kind, 'size (cm): ' || p_size || '; col_7: ' || p_brand AS text, 0 AS part, '' AS path FROM part
UNION ALL SELECT p_partkey, 'heading', p_name, 1, p_name FROM part UNION ALL SELECT p_partkey, 'list', p_type, 2, p_name FROM part
UNION ALL SELECT p_partkey, 'caption', p_brand, 3, p_name FROM part UNION ALL SELECT p_partkey, 'figure', '', 4, p_name FROM part)
SELECT doc_id, part::BIGINT AS block, kind, text, path, kind || '_' || (doc_id % 3 + 1) || '_1' AS element_id, CASE WHEN kind = 'table_row' THEN '0.0,1.0,8.0,9.0' ELSE '0.0,0.0,1.0,1.0' END AS bbox FROM c"""
)
def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a page layout: a table of a header and a row, a title, a list item, a caption and a picture."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_partkey") % 3 + 1).cast("int").alias("page"), F.lit(1).alias("item"), "p_name", "p_type", "p_brand", F.col("p_size").cast("string").alias("s"))
    box = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    cell = lambda row, col, value, b: F.struct(F.lit(row).alias("row"), F.lit(col).alias("col"), value.alias("text"), b.alias("bbox"))
    cells = parts.select("doc_id", "page", "item", F.inline(F.array(cell(0, 0, F.lit("size (cm)"), box(0, 0, 4, 1)), cell(1, 7, F.col("p_brand"), box(4, 1, 8, 8)), cell(1, 0, F.col("s"), box(0, 2, 4, 9)), cell(1, 2, F.lit(" "), box(9, 9, 9, 9)))))
    named = lambda label, value: F.struct(label.alias("label"), value.alias("text"))
    texts = parts.select("doc_id", "page", F.posexplode(F.array(named(F.lit("title"), F.col("p_name")), named(F.lit("list_item"), F.col("p_type")))).alias("item", "x"))
    texts = texts.select("doc_id", "page", "item", "x.label", "x.text", box(0, 0, 1, 1).alias("bbox"))
    captions = parts.select("doc_id", "page", "item", F.lit(None).cast("string").alias("label"), F.col("p_brand").alias("text"), box(0, 0, 1, 1).alias("bbox"))
    found = layout.layout_blocks(cells, texts, captions, parts.select("doc_id", "page", "item", box(0, 0, 1, 1).alias("bbox")))
    return found.select("doc_id", "block", "kind", "text", F.array_join("section_path", " > ").alias("path"), "element_id", F.array_join(F.col("bbox").cast("array<string>"), ",").alias("bbox"))


@query(
    """WITH p AS (SELECT doc_id, list_transform(range(greatest(1, doc_id % 13)), lambda i: substr(text, (i * 40 + 1)::BIGINT, 40 + (doc_id % 5) * 30)) AS x FROM documents),
q AS (SELECT doc_id, x, len(x) AS n, list_distinct(CASE WHEN len(x) > 10 THEN [0, len(x) // 4, len(x) // 2, 3 * len(x) // 4, len(x) - 1] WHEN len(x) > 2 THEN [0, len(x) // 2, len(x) - 1] ELSE [0, len(x) - 1] END) AS i FROM p)
SELECT doc_id, coalesce(list_sum(list_transform(i, lambda k: length(regexp_replace(x[k + 1], '^\\s+|\\s+$', '', 'g')))), 0) / len(i) < 100 AS needs_ocr FROM q"""
)
def ocr_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into up to 12 overlapping pages."""
    pages = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.col("doc_id") % 13) - 1), lambda i: F.substr("text", (i * 40 + 1).cast("int"), (40 + (F.col("doc_id") % 5) * 30).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", layout.needs_ocr(pages).alias("needs_ocr"))


_FACTS = "p_type || ' Flow rate: ' || p_size || '.5 m3/h, Pressure = ' || (p_partkey % 7) || ' bar; pressure: 9 bar'"


@query(
    """SELECT p_partkey AS doc_id, p_type || ' Flow rate' AS parameter, p_size || '.5' AS value, 'm3/h' AS unit FROM part UNION ALL SELECT p_partkey, 'Pressure', (p_partkey % 7)::VARCHAR, 'bar' FROM part"""
)
def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.measurements(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(_FACTS).alias("text")))


@query(
    """SELECT p_partkey AS doc_id, lower(p_name) AS src, 'feeds' AS type, lower(p_type) AS dst FROM part WHERE p_size % 2 = 0 UNION ALL
SELECT p_partkey, lower(p_type), 'discharges_to', lower(p_name) FROM part WHERE p_size % 2 = 0"""
)
def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences about each part; both sides are known entities where the size is even."""
    parts = table(spark, sf_dir, "part")
    docs = parts.select(F.col("p_partkey").alias("doc_id"), F.expr("p_name || ' feeds ' || p_type || '. ' || p_type || ' drains into ' || p_name || '; lead'").alias("text"))
    known = parts.select(F.col("p_partkey").alias("doc_id"), F.explode(F.when(F.col("p_size") % 2 == 0, F.array("p_name", "p_type")).otherwise(F.array("p_name"))).alias("label"))
    return graph.relations(docs, known)


@query("SELECT doc_id, label FROM (SELECT p_partkey AS doc_id, unnest(list_distinct([upper(p_type) || ' UNIT ' || (10 + p_size), 'MBR TANK'])) AS label FROM part)")
def upper_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("'the ' || upper(p_type) || ' UNIT ' || (10 + p_size) || ' near an MBR TANK, then ABC, mbr tank and the MBR TANK'")
    return graph.upper_entities(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), said.alias("text")))


_LABELS = "unnest([p_name, p_type, p_brand, p_partkey::VARCHAR, 'ISBN ' || p_partkey, 'page ' || p_size, 'Figure ' || p_size || ' shows', '--- ' || p_size, substr(p_name, 1, 1), 'a' || (p_partkey + 1000000000000)])"


@query(
    f"""WITH l AS (SELECT DISTINCT label FROM (SELECT {_LABELS} AS label FROM part)), n AS (SELECT label, lower(trim(label, ' ')) AS x FROM l)
SELECT label, length(x) < 2 OR {" OR ".join(f"regexp_matches(x, '{p}')" for p in graph.JUNK)} OR len(regexp_extract_all(x, '[0-9]')) / greatest(length(x), 1) > 0.9 OR len(regexp_extract_all(x, '\\p{{L}}')) / greatest(length(x), 1) < 0.4 AS junk FROM n"""
)
def junk_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.expr("array(p_name, p_type, p_brand, string(p_partkey), 'ISBN ' || p_partkey, 'page ' || p_size, 'Figure ' || p_size || ' shows', '--- ' || p_size, substr(p_name, 1, 1), 'a' || (p_partkey + 1000000000000))")
    rows = table(spark, sf_dir, "part").select(F.explode(made).alias("label")).distinct()
    return rows.select("label", graph.junk(F.col("label")).alias("junk"))
