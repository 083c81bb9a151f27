"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from .audio import op1_telephony
from .bpe import op6_bpe
from .chat import op5_chat_format
from .decontaminate import op10_decontaminate
from .jaccard import op4_jaccard_join
from .line_dedup import op9_line_dedup
from .quality_crf import op3_quality_crf
from .token_store import op7_token_store
from .toxicity import op8_toxicity
from .warc import op2_warc

QUERIES = {
    "op1_telephony": op1_telephony,
    "op2_warc": op2_warc,
    "op3_quality_crf": op3_quality_crf,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_chat_format": op5_chat_format,
    "op6_bpe": op6_bpe,
    "op7_token_store": op7_token_store,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontaminate": op10_decontaminate,
}

_WORD = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"

LINES_SQL = f"""
line AS (
  SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS no,
         unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
worded AS (SELECT doc_id, no, regexp_extract_all(lower(line), '{_WORD}') AS w FROM line),
placed AS (
  SELECT *, array_to_string(w, ' ') AS k, row_number() OVER (ORDER BY doc_id, no) AS place FROM worded WHERE len(w) > 0),
firsts AS (SELECT k, len(any_value(w)) < 8 AS short, CASE WHEN len(any_value(w)) < 8 THEN string_split(k, '') ELSE any_value(w) END AS u, min(place) AS place FROM placed GROUP BY k),
bases AS (SELECT *, unnest([len(u), len(u) - 1]) AS base FROM firsts),
halves AS (
  SELECT short, base, 1 AS side, u[1:base//2] AS half, u, place FROM bases WHERE base >= 8
  UNION ALL SELECT short, base, 2, u[len(u)-(base-base//2)+1:], u, place FROM bases WHERE base >= 8),
pairs AS (
  SELECT DISTINCT a.u AS s, b.u AS t, a.place AS sat, b.place AS tat FROM halves a JOIN halves b USING (short, base, side, half)
  WHERE len(a.u) = base AND a.place <> b.place),
near AS (
  SELECT greatest(sat, tat) AS place FROM pairs
  WHERE CASE WHEN len(s) = len(t) THEN len(list_filter(list_zip(s, t), lambda z: z[1] <> z[2])) = 1
        ELSE len(list_filter(range(1, len(t) + 1), lambda i: list_concat(t[1:i-1], t[i+1:]) = s)) > 0 END),
gone AS (
  SELECT doc_id, no FROM placed JOIN firsts USING (k) WHERE placed.place > firsts.place
  UNION SELECT doc_id, no FROM placed JOIN near USING (place))
"""

ORACLE = {
    "op5_chat_format": """
WITH t AS (
  SELECT conv_id, turn, coalesce(replace(role, '<|im_', '<| im_'), '') AS role, coalesce(replace(text, '<|im_', '<| im_'), '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
             '<|im_start|>' || role || chr(10) AS head, '<|im_end|>' || chr(10) AS tail FROM t),
o AS (SELECT *, octet_length(encode(head)) AS h, octet_length(encode(text)) AS c,
             sum(octet_length(encode(head || text || tail))) OVER (PARTITION BY conv_id ORDER BY i) - octet_length(encode(head || text || tail)) AS base FROM n)
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, string_agg(head || text || tail, '' ORDER BY i) AS text,
       coalesce(list({'start': CAST(base + h AS BIGINT), 'end': CAST(base + h + c AS BIGINT)} ORDER BY i) FILTER (WHERE role = 'assistant'), []) AS spans
FROM o GROUP BY conv_id
""",
    "op4_jaccard_join": f"""
WITH RECURSIVE dw AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
sets AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 2 THEN [w] ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i:i+1]))) END AS s
  FROM dw WHERE len(w) > 0),
content AS (SELECT s, min(doc_id) AS first, count(*) AS k, len(s) AS n FROM sets GROUP BY s),
tok AS (SELECT first, k, n, unnest(s) AS g FROM content),
common AS (SELECT a.first AS x, b.first AS y, any_value(b.k) AS k, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
  FROM tok a JOIN tok b ON a.g = b.g AND a.first <> b.first AND b.n >= 0.6 * a.n AND a.n >= 0.6 * b.n GROUP BY a.first, b.first),
near AS (SELECT x, y, k FROM common WHERE round(c / (nx + ny - c), 9) >= 0.6),
part(x, y) AS (SELECT first, first FROM content UNION SELECT part.x, near.y FROM part JOIN near ON near.x = part.y),
class AS (SELECT x, min(y) AS class_id FROM part GROUP BY x),
links AS (SELECT x, sum(k) AS links FROM near GROUP BY x),
own AS (SELECT doc_id, class_id, k - 1 + coalesce(links, 0) AS n FROM sets JOIN content USING (s) JOIN class ON class.x = first LEFT JOIN links ON links.x = first)
SELECT doc_id, coalesce(min(class_id), doc_id) AS class_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) LEFT JOIN own USING (doc_id) GROUP BY doc_id
""",
    "op9_line_dedup": f"""
WITH {LINES_SQL},
kept AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE gone.no IS NULL), '') AS text, count(gone.no) AS n_dropped
  FROM line LEFT JOIN gone USING (doc_id, no) GROUP BY doc_id)
SELECT doc_id, text, CAST(n_dropped AS INTEGER) AS n_dropped FROM kept
UNION ALL SELECT doc_id, text, 0 FROM documents WHERE doc_id IS NULL OR text IS NULL
""",
    "op10_decontaminate": f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM documents WHERE doc_id IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL),
ig AS (SELECT DISTINCT item_id, len(w) - 3 AS win, w[i:i+3] AS g FROM (SELECT *, unnest(generate_series(1, len(w) - 3)) AS i FROM iw WHERE len(w) >= 4)
  UNION SELECT item_id, 1, w FROM iw WHERE len(w) BETWEEN 1 AND 3),
im AS (SELECT item_id, win, count(*) AS m FROM ig GROUP BY ALL),
dg AS (SELECT doc_id, i - 1 AS place, w[i:i+3] AS g FROM (SELECT *, unnest(generate_series(1, len(w) - 3)) AS i FROM dw WHERE len(w) >= 4)
  UNION ALL SELECT doc_id, i - 1, w[i:i+k-1] FROM (SELECT *, unnest(generate_series(1, len(w) - k + 1)) AS i FROM dw, (SELECT DISTINCT len(w) AS k FROM iw WHERE len(w) BETWEEN 1 AND 3) WHERE len(w) >= k)),
hit AS (SELECT doc_id, item_id, place, g FROM dg JOIN ig USING (g)),
slid AS (
  SELECT r.doc_id, r.item_id, r.place AS r, count(DISTINCT l.g) AS c, min(l.place) AS low
  FROM hit r JOIN im USING (item_id) JOIN hit l ON l.doc_id = r.doc_id AND l.item_id = r.item_id AND l.place <= r.place AND l.place > r.place - im.win
  GROUP BY ALL),
top AS (SELECT doc_id, item_id, max(c) AS c FROM slid GROUP BY ALL)
SELECT t.doc_id, t.item_id, t.c / im.m AS containment, CAST((SELECT arg_min(s.low, s.r) FROM slid s WHERE s.doc_id = t.doc_id AND s.item_id = t.item_id AND s.c = t.c) AS BIGINT) AS word_at
FROM top t JOIN im USING (item_id) WHERE t.c >= ceil(round(0.7 * im.m, 9))
""",
}
