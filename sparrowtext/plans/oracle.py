"""DuckDB SQL for the registered search queries."""

from __future__ import annotations

from ..functions.analysis import _DROPPED, _TRIMMED, STOP_WORDS

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_VC = "[aeiou][^aeiou]"


def _cut(column: str, n: int) -> str:
    return f"left({column}, length({column}) - {n})"


def _mended(x: str) -> str:
    """What is left after -ed or -ing, with its e back or its double consonant undone."""
    return (
        f"CASE WHEN regexp_matches({x}, '(at|bl|iz)$') THEN {x} || 'e' "
        f"WHEN length({x}) >= 2 AND right({x}, 1) = left(right({x}, 2), 1) AND regexp_matches({x}, '[b-df-hjkmnp-rtv-y0-9]$') THEN {_cut(x, 1)} ELSE {x} END"
    )


def stems(vocabulary: str) -> str:
    """CTEs that end in stem(w, term) for a relation with a column w."""
    rules = [("ational", "ate"), *[tuple(x.split(":")) for x in _TRIMMED], ("ization", "ize"), *[(d, "") for d in _DROPPED]]
    rules.sort(key=lambda r: -len(r[0]))
    derived = " ".join(f"WHEN b LIKE '%{s}' THEN CASE WHEN regexp_matches({_cut('b', len(s))}, '{_VC}') THEN {_cut('b', len(s))} || '{r}' ELSE b END" for s, r in rules)
    return f"""
st1 AS (SELECT w, octet_length(encode(w)) <= 3 AS short,
  CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {_cut('w', 2)} WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN {_cut('w', 1)} ELSE w END AS a FROM {vocabulary}),
st2 AS (SELECT w, short, a, CASE
  WHEN a LIKE '%eed' THEN 'k' WHEN a LIKE '%ed' AND regexp_matches({_cut('a', 2)}, '[aeiou]') THEN 'd'
  WHEN a LIKE '%ing' AND NOT a LIKE '%ed' AND regexp_matches({_cut('a', 3)}, '[aeiou]') THEN 'g' ELSE '' END AS kind FROM st1),
st3 AS (SELECT w, short, a, kind, CASE kind WHEN 'd' THEN {_cut('a', 2)} WHEN 'g' THEN {_cut('a', 3)} ELSE '' END AS x FROM st2),
st4 AS (SELECT w, short, CASE WHEN kind = 'k' THEN CASE WHEN regexp_matches({_cut('a', 3)}, '{_VC}') THEN {_cut('a', 1)} ELSE a END
  WHEN kind = '' THEN a ELSE {_mended('x')} END AS b FROM st3),
st5 AS (SELECT w, short, CASE {derived} ELSE b END AS c FROM st4),
stem AS (SELECT w, CASE WHEN short THEN w WHEN c LIKE '%e' AND regexp_matches({_cut('c', 1)}, '{_VC}.*{_VC}') THEN {_cut('c', 1)} ELSE c END AS term FROM st5)"""


def index(sources: dict[str, str] | None = None, documents: str = "SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents") -> str:
    """CTEs docs, lengths, post(field, term, doc_id, tf, positions, doc_len), dict(field, term, df, ttf) and fs(field, avg_len).

    sources: for each field a query of (doc_id, text).
    """
    sources = sources or {f: f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, {f} AS text FROM documents" for f in ("text", "lang", "source")}
    union = " UNION ALL ".join(f"SELECT '{f}' AS field, doc_id, text FROM ({q}) WHERE text IS NOT NULL" for f, q in sources.items())
    return f"""
docs AS ({documents}),
src AS ({union}),
toks AS (SELECT field, doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+'), lambda x: x NOT IN ({STOPS})) AS ws FROM src),
lengths AS (SELECT field, doc_id, len(ws) AS doc_len FROM toks),
flat AS (SELECT field, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM toks),
vocab AS (SELECT DISTINCT w FROM flat),
{stems('vocab')},
post AS (SELECT f.field, s.term, f.doc_id, count(*) AS tf, list(CAST(f.pos AS INTEGER) ORDER BY f.pos) AS positions, any_value(l.doc_len) AS doc_len
  FROM flat f JOIN stem s USING (w) JOIN lengths l ON l.field = f.field AND l.doc_id = f.doc_id GROUP BY f.field, s.term, f.doc_id),
dict AS (SELECT field, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ttf FROM post GROUP BY field, term),
fs AS (SELECT field, count(*) AS n_docs, CAST(sum(doc_len) AS BIGINT) AS total_len, avg(doc_len) AS avg_len FROM lengths GROUP BY field),
nd AS (SELECT count(*) AS n FROM docs),
bm AS (SELECT p.field, p.term, p.doc_id, p.tf, p.positions, d.df,
  ln(1 + (n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) * (p.tf * 2.2::DOUBLE) / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.doc_len / fs.avg_len)) AS s
  FROM post p JOIN dict d USING (field, term) JOIN fs USING (field), nd)"""


def ranked(scored: str, n: int, ctes: str = "", base: str | None = None) -> str:
    """The first n of a query of (doc_id, score), in the columns of the search."""
    return f"""WITH {base or index()} {',' + ctes if ctes else ''},
scored AS ({scored})
SELECT CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score, total FROM (
  SELECT row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, score, count(*) OVER () AS total FROM scored)
WHERE {f'rank <= {n}' if n else 'true'}"""


def leaf(where: str) -> str:
    return f"SELECT doc_id, sum(s) AS score FROM bm WHERE {where} GROUP BY doc_id"


def cells(cell: str, kind: str, value: str, pairs: str) -> str:
    """`value` from the table m, row by row, of an edit distance of a and b; `cell`: the entry at i, j > 0, number k from 0."""
    return f"""
WITH RECURSIVE p AS (SELECT a, b, length(a) AS la, length(b) AS lb {pairs}),
r(a, b, la, lb, n, m) AS (
  SELECT a, b, la, lb, 0, CAST([] AS {kind}[]) FROM p
  UNION ALL SELECT a, b, la, lb, n + 1, list_append(m, CAST(CASE WHEN i = 0 THEN j WHEN j = 0 THEN i ELSE {cell} END AS {kind}))
  FROM (SELECT *, n AS k, n // (lb + 1) AS i, n % (lb + 1) AS j FROM r) WHERE n < (la + 1) * (lb + 1))
SELECT a, b, {value} AS value FROM r WHERE n = (la + 1) * (lb + 1)"""
