"""DuckDB forms of the queries of this subpackage that SQL can express."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, {_WORDS.format("t")} AS w FROM d
), p AS (
  SELECT r, len(w) AS n, w, unnest(range(1, len(w) + 1)) AS i FROM w
), g AS (
  SELECT r, n, i,
    CASE WHEN i + 2 <= n THEN array_to_string(w[i:i + 2], ' ') END AS g3,
    CASE WHEN i + 9 <= n THEN array_to_string(w[i:i + 9], ' ') END AS g10,
    CASE WHEN i + 100 <= n THEN md5(array_to_string(w[i:i + 100], ' ')) END AS g101
  FROM p
), c AS (
  SELECT r, i,
    CASE WHEN g3 IS NOT NULL AND count(*) OVER (PARTITION BY r, g3) > 1 THEN i END AS at3,
    CASE WHEN g10 IS NOT NULL AND count(*) OVER (PARTITION BY r, g10) > 1 THEN i END AS at10,
    g101 IS NOT NULL AND count(*) OVER (PARTITION BY r, g101) > 1 AS far
  FROM g
), m AS (
  SELECT r, far,
    i - max(at3) OVER (PARTITION BY r ORDER BY i) < 3 AS in3,
    i - max(at10) OVER (PARTITION BY r ORDER BY i) < 10 AS in10
  FROM c
), s AS (
  SELECT r, count(*) FILTER (WHERE in3) AS n3, count(*) FILTER (WHERE in10) AS n10, coalesce(bool_or(far), false) AS far FROM m GROUP BY r
), l AS (
  SELECT r, line, row_number() OVER (PARTITION BY r, line) AS k
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dl AS (
  SELECT r, count(*) FILTER (WHERE k > 1) AS n FROM l GROUP BY r
), x AS (
  SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(w.t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(s.n3, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(s.n10, 0) AS BIGINT) AS n_covered_words,
    coalesce(s.far, false) AS far
  FROM w LEFT JOIN s USING (r) LEFT JOIN dl USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_covered_words <= 30 * n_words AND NOT far AS kept
FROM x
"""

OP2 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)
), sym AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT sym.b, reach.c FROM reach JOIN sym ON sym.a = reach.doc_id WHERE reach.c < sym.b
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id) m USING (doc_id)
"""

_ALNUM = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_ALNUM.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0 AND item IS NOT NULL)
), k AS (
  SELECT DISTINCT k FROM win
), at_ AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT r, w, k.k AS k, unnest(range(1, len(w) - k.k + 2)) AS i FROM d, k WHERE len(w) >= k.k)
), hit AS (
  SELECT r, at_.k AS k, i, item FROM at_ JOIN win ON win.k = at_.k AND win.s = at_.s
), words AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r
), items AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


OP6 = "SELECT doc_id, lang, source, length(text) AS n_chars, md5(text) AS text_md5 FROM documents"


def _json_string(text: str) -> str:
    out = f"replace(replace({text}, '\\', '\\\\'), '\"', '\\\"')"
    for code in range(1, 32):
        short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}.get(code, f"\\u{code:04x}")
        out = f"replace({out}, chr({code}), '{short}')"
    return f"('\"' || {out} || '\"')"


def _op10() -> str:
    prompt, result, role, message = (f"coalesce({_json_string(x)}, 'null')" for x in ("prompt", "result", "role", "message"))
    call = f"""'{{"arguments":{{"prompt":' || {prompt} || ',"turn":' || coalesce(CAST(turn AS VARCHAR), 'null') || '}},"id":' || coalesce('"' || call_id || '"', 'null') || ',"name":"respond"}}'"""
    told = f"""'{{"role":' || {role} || ',"text":' || {message} || ',"turn":' || coalesce(CAST(turn AS VARCHAR), 'null') || '}}'"""
    return f"""
WITH c AS (
  SELECT conv_id, conv_id || ':' || turn AS call_id, turn, text AS prompt FROM conversations WHERE role = 'user'
), r AS (
  SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, turn AS result_turn, text AS result FROM conversations WHERE role = 'assistant'
), known AS (
  SELECT conv_id, call_id, min(turn) AS turn FROM c WHERE call_id IS NOT NULL GROUP BY ALL
), due AS (
  SELECT r.*, k.turn IS NOT NULL AND result_turn >= k.turn AS ok,
    row_number() OVER (PARTITION BY r.conv_id, r.call_id, k.turn IS NOT NULL AND result_turn >= k.turn ORDER BY result_turn, result NULLS FIRST) AS nth,
    count(*) OVER (PARTITION BY r.conv_id, r.call_id) AS n
  FROM r LEFT JOIN known k ON k.conv_id = r.conv_id AND k.call_id = r.call_id
), chain AS (
  SELECT conv_id, call_id, turn,
    sum(CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.conv_id = k.conv_id AND r.result_turn = k.turn - 1) AND EXISTS (SELECT 1 FROM known b WHERE b.conv_id = k.conv_id AND b.turn = k.turn - 2)
      THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island
  FROM known k
), levels AS (
  SELECT conv_id, call_id, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS level FROM chain
), x AS (
  SELECT c.conv_id, c.call_id, c.turn, d.result_turn, CASE WHEN d.call_id IS NULL THEN 'pending' ELSE 'linked' END AS status, coalesce(d.n, 0) AS n_results,
    coalesce(level, 0) AS level, prompt, result, NULL AS role, NULL AS message
  FROM c LEFT JOIN due d ON d.ok AND d.nth = 1 AND d.conv_id = c.conv_id AND d.call_id = c.call_id LEFT JOIN levels v ON v.conv_id = c.conv_id AND v.call_id = c.call_id
  UNION ALL
  SELECT d.conv_id, d.call_id, NULL, result_turn, CASE WHEN ok THEN 'surplus' ELSE 'orphan' END, 0, CASE WHEN ok THEN level ELSE 0 END, NULL, result, NULL, NULL
  FROM due d LEFT JOIN levels v ON v.conv_id = d.conv_id AND v.call_id = d.call_id WHERE NOT ok OR nth > 1
  UNION ALL
  SELECT conv_id, NULL, turn, NULL, 'message', 0, 0, NULL, NULL, role, text FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
)
SELECT conv_id, call_id, turn, result_turn, status, CAST(n_results AS BIGINT) AS n_results, CAST(level AS BIGINT) AS level,
  lpad(CAST(coalesce(turn, result_turn, 0) AS VARCHAR), 19, '0') || '.' || lpad(CAST(2 * level + CASE WHEN status IN ('orphan', 'surplus') THEN 1 ELSE 0 END AS VARCHAR), 19, '0') AS order_key,
  NOT problem AS valid,
  CASE WHEN NOT problem THEN '' WHEN prompt IS NULL THEN 'prompt: missing' WHEN length(prompt) < 1 THEN 'prompt: too short' ELSE 'prompt: too long' END AS problems,
  '{{"call":' || CASE WHEN status IN ('linked', 'pending') THEN {call} ELSE 'null' END || ',"conversation":' || coalesce(CAST(conv_id AS VARCHAR), 'null')
    || CASE WHEN status = 'message' THEN ',"message":' || {told} ELSE '' END || ',"result":' || {result} || ',"status":"' || status || '"}}' AS json
FROM (SELECT *, status IN ('linked', 'pending') AND (prompt IS NULL OR length(prompt) < 1 OR length(prompt) > 100000) AS problem FROM x)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1, "op2_ngram_jaccard": OP2, "op5_decontamination": OP5, "op6_compaction": OP6, "op10_tool_links": _op10()}
