"""The registered search queries with their SQL: one for each operator, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analysis as an
from ..functions import similarity as sim
from ..functions.highlight import Highlighter
from ..operators import query as q
from ..operators import search as se
from ..operators.index import SearchIndex
from ..operators.parser import Parser
from ..sources.storage import documents, spread
from ..streaming.maintain import apply_changes
from . import oracle as o

Query = Callable[[SparkSession, str], DataFrame]
FIELDS = ["text", "lang", "source"]

_INDEXES: dict[tuple, SearchIndex] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The index of the table documents, written once in an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = SearchIndex.build(documents(spread(read(spark, sf_dir, "documents")).where("doc_id is not null"), "doc_id", FIELDS)).save()
    return _INDEXES[key]


def _searched(query: q.Query, n: int = 10) -> Query:
    return lambda spark, d: se.search(corpus(spark, d), query, n).withColumn("score", F.round("score", 6))


def _docs(made: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: made(spread(read(spark, d, "documents")))


def _pairs(made: Callable) -> Query:
    """A function of all pairs of names of nations."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        n = read(spark, d, "nation")
        both = n.select(F.col("n_name").alias("a")).crossJoin(n.select(F.col("n_name").alias("b")))
        return both.select("a", "b", made(F.col("a"), F.col("b")).alias("value"))

    return run


def _upserted(spark: SparkSession, d: str) -> DataFrame:
    """English documents get the text of a benchmark item, by id; those of source src1 go; then a search."""
    docs, items = read(spark, d, "documents"), read(spark, d, "benchmark")
    new = docs.where("lang = 'en'").join(items.select(F.col("item_id").alias("doc_id"), F.col("text").alias("t")), "doc_id")
    changed = corpus(spark, d).add(documents(new.select("doc_id", F.col("t").alias("text"), "lang", "source"), "doc_id", FIELDS))
    changed = changed.delete(docs.where("source = 'src1'").select("doc_id"))
    return se.search(changed, q.Term("text", "from"), 0).withColumn("score", F.round("score", 6))


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    """The changes that the table events stands for, merged: a purchase deletes the user's document, anything else writes it."""
    ev = read(spark, d, "events")
    op = F.when(F.col("event_type") == "purchase", F.lit("delete")).otherwise(F.lit("add"))
    fields = F.create_map(F.lit("type"), F.col("event_type"))
    changes = ev.select(op.alias("op"), F.col("user_id").cast("string").alias("doc_id"), fields.alias("fields"), F.col("event_id").alias("seq"))
    start = SearchIndex.build(spark.createDataFrame([], "doc_id string, fields map<string,string>"))
    return se.facet_counts(apply_changes(start, changes), "type")


def _repeated(spark: SparkSession, d: str) -> DataFrame:
    """Documents under forty ids, so that each comes many times: the last one counts."""
    docs = read(spark, d, "documents").where("doc_id is not null").withColumn("seq", F.col("doc_id"))
    index = SearchIndex.build(documents(docs, F.col("doc_id") % 40, FIELDS, "seq"), sequence="seq")
    more = documents(docs.where("doc_id % 3 = 0").withColumn("seq", -F.col("doc_id")), F.col("doc_id") % 20, FIELDS, "seq")  # here the first
    return se.search(index.add(more, "seq"), q.Prefix("text", "th"), 0).withColumn("score", F.round("score", 6))


def _present(spark: SparkSession, d: str) -> DataFrame:
    """Which ids of labels and items are documents."""
    ids = read(spark, d, "labels").select("doc_id").union(read(spark, d, "benchmark").select("item_id")).where("doc_id is not null")
    return corpus(spark, d).present(ids.union(ids.select(-F.col("doc_id") - 1)))


HIGHLIGHT = Parser().parse('from "of the" ste* +lang:und -clown')
TREE = "from +th* -idiot lang:en"

QUERIES: dict[str, Query] = {
    "tokenize": _docs(lambda x: x.select("doc_id", an.tokenize(F.col("text")).alias("tokens"))),
    "analyze_standard": _docs(lambda x: x.select("doc_id", an.STANDARD.terms(F.col("text")).alias("terms"))),
    "stem_vocab": _docs(lambda x: x.select(F.explode(an.tokenize(an.lower(F.col("text")))).alias("w")).distinct().select("w", an.stem(F.col("w")).alias("term"))),
    "postings": lambda s, d: corpus(s, d).postings.select("field", "term", "doc_id", "tf", "positions", "doc_len"),
    "field_stats": lambda s, d: corpus(s, d).field_stats().withColumn("avg_len", F.round("avg_len", 6)),
    "fields": lambda s, d: corpus(s, d).fields.orderBy("field"),
    "num_docs": lambda s, d: corpus(s, d).documents.agg(F.count("*").alias("n_docs")),
    "facet_lang": lambda s, d: se.facet_counts(corpus(s, d), "lang"),
    "facet_text": lambda s, d: se.facet_counts(corpus(s, d), "text"),
    "doc_freq": lambda s, d: se.doc_freq(corpus(s, d), "text", "From"),
    "total_term_freq": lambda s, d: se.total_term_freq(corpus(s, d), "text", "From"),
    "term_count": lambda s, d: se.term_count(corpus(s, d), "text"),
    "terms": lambda s, d: se.terms(corpus(s, d), "text"),
    "term_bm25_topn": _searched(q.Term("text", "from")),
    "terms_bm25": _searched(q.Terms("text", ("from", "Idiot", "clown", "FROM"))),
    "prefix_bm25": _searched(q.Prefix("text", "thre")),
    "range_bm25": _searched(q.Range("text", "thr", "ths", True, False)),
    "wildcard_bm25": _searched(q.Wildcard("text", "t*re?")),
    "regexp_bm25": _searched(q.Regexp("text", "(th|on)+re?")),
    "fuzzy_bm25": _searched(q.Fuzzy("text", "clown", 2)),
    "phrase_bm25": _searched(q.Phrase("text", ("Released", "under", "MIT")), 0),
    "phrase_stop_word": _searched(q.Phrase("text", ("under", "the", "MIT")), 0),
    "match_all": _searched(q.MatchAll(), 0),
    "bool_must_should": _searched(q.Bool().add(q.Term("text", "from"), q.Occur.MUST).add(q.Term("text", "idiot")).add(q.Prefix("text", "thre"))),
    "bool_must_not": _searched(q.Bool().add(q.Term("text", "from")).add(q.Term("lang", "de")).add(q.Prefix("text", "thre"), q.Occur.MUST_NOT)),
    "bool_only_not": _searched(q.Bool().add(q.Term("text", "from"), q.Occur.MUST_NOT)),
    "boost": _searched(q.boost(q.Term("text", "from"), 2.5)),
    "constant_score": _searched(q.constant_score(q.Prefix("text", "thre"), 3.0)),
    "dismax_multifield": _searched(q.dis_max(0.3, q.Term("text", "from"), q.Term("lang", "en"), q.Term("text", "idiot"))),
    "parsed_query": lambda s, d: se.search_string(corpus(s, d), TREE, 10).withColumn("score", F.round("score", 6)),
    "parsed_phrase": lambda s, d: se.search_string(corpus(s, d), 'text:"Released under MIT"', 0).withColumn("score", F.round("score", 6)),
    "parsed_range": lambda s, d: se.search_string(corpus(s, d), "text:[thr TO ths}", 10).withColumn("score", F.round("score", 6)),
    "parsed_group": lambda s, d: se.search_string(corpus(s, d), "+(text:from text:idiot) +lang:de", 10).withColumn("score", F.round("score", 6)),
    "match_count": lambda s, d: se.count(corpus(s, d), Parser().parse("+text:from lang:de")),
    "match_count_none": lambda s, d: se.count(corpus(s, d), q.Term("text", "no such term")),
    "suggest": lambda s, d: se.suggest(corpus(s, d), "text", " Thr", 15),
    "spellcheck": lambda s, d: se.spell_check(corpus(s, d), "text", "clwn", 2, 20),
    "more_like_this": lambda s, d: se.more_like_this(corpus(s, d), "7", "text", 10).withColumn("score", F.round("score", 6)),
    "ngrams": lambda s, d: read(s, d, "part").select("p_partkey", an.ngrams(F.col("p_name"), 3).alias("grams")),
    "edge_ngrams": lambda s, d: read(s, d, "part").select("p_partkey", an.edge_ngrams(F.col("p_name"), 2, 6).alias("grams")),
    "shingles": _docs(lambda x: x.select("doc_id", an.shingles(an.tokenize(F.col("text")), 3).alias("shingles"))),
    "soundex_names": lambda s, d: read(s, d, "nation").select("n_name", an.soundex(F.col("n_name")).alias("code")),
    "levenshtein_pairs": _pairs(sim.levenshtein),
    "osa_pairs": _pairs(sim.osa),
    "jaro_pairs": _pairs(lambda a, b: F.round(sim.jaro(a, b), 6)),
    "jaro_winkler_pairs": _pairs(lambda a, b: F.round(sim.jaro_winkler(a, b), 6)),
    "lev_similarity_pairs": _pairs(lambda a, b: F.round(sim.levenshtein_similarity(a, b), 6)),
    "ngram_similarity_pairs": _pairs(lambda a, b: F.round(sim.ngram_similarity(a, b, 2), 6)),
    "wildcard_match_names": lambda s, d: read(s, d, "part").select("p_partkey", sim.wildcard_match(F.col("p_name"), "*e? *a*").alias("matches")),
    "highlight": _docs(lambda x: x.select("doc_id", Highlighter("<b>", "</b>").highlight(F.col("text"), HIGHLIGHT).alias("marked"))),
    "upsert_delete_search": _upserted,
    "upsert_repeated_ids": _repeated,
    "present": _present,
    "stream_changes": _streamed,
}

_TOK = r"regexp_extract_all(text, '[\p{L}\p{Nd}]+')"
_NATIONS = "FROM (SELECT n_name AS a FROM nation), (SELECT n_name AS b FROM nation)"
_ASCII = "regexp_replace(term, '[^ -~]', '#', 'g')"  # DuckDB counts the edits of bytes
_BOTH = "coalesce(x.score, 0) + coalesce(y.score, 0)"


def _leaf(where: str, n: int = 10) -> str:
    return o.ranked(o.leaf(where), n)


def _phrase(*terms: str) -> str:
    join = " ".join(f"JOIN bm t{i} ON t{i}.field = 'text' AND t{i}.doc_id = t0.doc_id AND t{i}.term = '{t}'" for i, t in enumerate(terms) if i)
    total = " + ".join(f"t{i}.s" for i in range(len(terms)))
    holds = " AND ".join(f"list_contains(t{i}.positions, x + {i})" for i in range(1, len(terms)))
    return o.ranked(f"SELECT t0.doc_id, {total} AS score FROM bm t0 {join} WHERE t0.field = 'text' AND t0.term = '{terms[0]}' AND len(list_filter(t0.positions, lambda x: {holds})) > 0", 0)


_LAST = {
    f: f"""SELECT doc_id, {f} AS text FROM last"""
    for f in FIELDS
}
_LAST_CTE = """firsts AS (SELECT CAST(doc_id % 40 AS VARCHAR) AS doc_id, text, lang, source, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id DESC) AS r FROM documents WHERE doc_id IS NOT NULL),
seconds AS (SELECT CAST(doc_id % 20 AS VARCHAR) AS doc_id, text, lang, source, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id) AS r FROM documents WHERE doc_id % 3 = 0),
last AS (SELECT * FROM seconds WHERE r = 1 UNION ALL SELECT * FROM firsts WHERE r = 1 AND doc_id NOT IN (SELECT doc_id FROM seconds))"""
_CHANGED = {
    f: f"""SELECT doc_id, {f} AS text FROM (
  SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, CASE WHEN d.lang = 'en' AND b.item_id IS NOT NULL THEN b.text ELSE d.text END AS text, d.lang, d.source
  FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id WHERE d.source IS DISTINCT FROM 'src1')"""
    for f in FIELDS
}

ORACLE: dict[str, str] = {
    "tokenize": f"SELECT doc_id, {_TOK} AS tokens FROM documents",
    "analyze_standard": f"""WITH {o.index({'text': 'SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents'})}
SELECT CAST(l.doc_id AS BIGINT) AS doc_id, coalesce(list(s.term ORDER BY f.pos) FILTER (WHERE s.term IS NOT NULL), []) AS terms
FROM lengths l LEFT JOIN flat f USING (field, doc_id) LEFT JOIN stem s USING (w) GROUP BY l.doc_id""",
    "stem_vocab": f"WITH vocab AS (SELECT DISTINCT unnest({_TOK.replace('text', 'lower(text)')}) AS w FROM documents), {o.stems('vocab')} SELECT w, term FROM stem",
    "postings": f"WITH {o.index()} SELECT field, term, doc_id, tf, positions, doc_len FROM post",
    "field_stats": f"WITH {o.index()} SELECT field, n_docs, total_len, round(avg_len, 6) AS avg_len FROM fs",
    "fields": f"WITH {o.index()} SELECT field FROM fs",
    "num_docs": "SELECT count(DISTINCT doc_id) AS n_docs FROM documents",
    "facet_lang": f"WITH {o.index()} SELECT term AS value, df AS count FROM dict WHERE field = 'lang'",
    "facet_text": f"WITH {o.index()} SELECT term AS value, df AS count FROM dict WHERE field = 'text'",
    "doc_freq": f"WITH {o.index()} SELECT coalesce(sum(df), 0)::BIGINT AS df FROM dict WHERE field = 'text' AND term = 'from'",
    "total_term_freq": f"WITH {o.index()} SELECT coalesce(sum(ttf), 0)::BIGINT AS ttf FROM dict WHERE field = 'text' AND term = 'from'",
    "term_count": f"WITH {o.index()} SELECT count(*) AS n_terms FROM dict WHERE field = 'text'",
    "terms": f"WITH {o.index()} SELECT term FROM dict WHERE field = 'text'",
    "term_bm25_topn": _leaf("field = 'text' AND term = 'from'"),
    "terms_bm25": _leaf("field = 'text' AND term IN ('from', 'idiot', 'clown')"),
    "prefix_bm25": _leaf("field = 'text' AND starts_with(term, 'thre')"),
    "range_bm25": _leaf("field = 'text' AND term >= 'thr' AND term < 'ths'"),
    "wildcard_bm25": _leaf("field = 'text' AND term LIKE 't%re_'"),
    "regexp_bm25": _leaf("field = 'text' AND regexp_full_match(term, '(th|on)+re?')"),
    "fuzzy_bm25": _leaf(f"field = 'text' AND abs(length(term) - 5) <= 2 AND levenshtein({_ASCII}, 'clown') <= 2"),
    "phrase_bm25": _phrase("releas", "und", "mit"),
    "phrase_stop_word": o.ranked("SELECT doc_id, s AS score FROM bm WHERE false", 0),
    "match_all": o.ranked("SELECT doc_id, 1.0::DOUBLE AS score FROM docs", 0),
    "bool_must_should": o.ranked(
        "SELECT m.doc_id, m.score + coalesce(x.score, 0) + coalesce(y.score, 0) AS score FROM m LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)",
        10,
        f"m AS ({o.leaf('''field = 'text' AND term = 'from' ''')}), x AS ({o.leaf('''field = 'text' AND term = 'idiot' ''')}), y AS ({o.leaf('''field = 'text' AND starts_with(term, 'thre')''')})",
    ),
    "bool_must_not": o.ranked(
        f"SELECT doc_id, {_BOTH} AS score FROM x FULL JOIN y USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM z)",
        10,
        f"x AS ({o.leaf('''field = 'text' AND term = 'from' ''')}), y AS ({o.leaf('''field = 'lang' AND term = 'de' ''')}), z AS ({o.leaf('''field = 'text' AND starts_with(term, 'thre')''')})",
    ),
    "bool_only_not": o.ranked("SELECT doc_id, s AS score FROM bm WHERE false", 10),
    "boost": o.ranked(f"SELECT doc_id, score * 2.5::DOUBLE AS score FROM ({o.leaf('''field = 'text' AND term = 'from' ''')})", 10),
    "constant_score": o.ranked(f"SELECT doc_id, 3.0::DOUBLE AS score FROM ({o.leaf('''field = 'text' AND starts_with(term, 'thre')''')})", 10),
    "dismax_multifield": o.ranked(
        "SELECT doc_id, max(score) + 0.3::DOUBLE * (sum(score) - max(score)) AS score FROM (SELECT * FROM x UNION ALL SELECT * FROM y UNION ALL SELECT * FROM z) GROUP BY doc_id",
        10,
        f"x AS ({o.leaf('''field = 'text' AND term = 'from' ''')}), y AS ({o.leaf('''field = 'lang' AND term = 'en' ''')}), z AS ({o.leaf('''field = 'text' AND term = 'idiot' ''')})",
    ),
    "parsed_query": o.ranked(
        "SELECT m.doc_id, m.score + coalesce(x.score, 0) + coalesce(y.score, 0) AS score FROM m LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id) WHERE m.doc_id NOT IN (SELECT doc_id FROM z)",
        10,
        f"x AS ({o.leaf('''field = 'text' AND term = 'from' ''')}), m AS ({o.leaf('''field = 'text' AND starts_with(term, 'th')''')}), z AS ({o.leaf('''field = 'text' AND term = 'idiot' ''')}), y AS ({o.leaf('''field = 'lang' AND term = 'en' ''')})",
    ),
    "suggest": f"WITH {o.index()} SELECT term, df FROM dict WHERE field = 'text' AND starts_with(term, 'thr') ORDER BY df DESC, term LIMIT 15",
    "spellcheck": f"""WITH {o.index()} SELECT term, CAST(levenshtein({_ASCII}, 'clwn') AS INTEGER) AS edits, df FROM dict
WHERE field = 'text' AND levenshtein({_ASCII}, 'clwn') <= 2 AND term <> 'clwn' ORDER BY edits, df DESC, term LIMIT 20""",
    "more_like_this": o.ranked(
        "SELECT bm.doc_id, sum(bm.s) AS score FROM bm JOIN chosen USING (term) WHERE field = 'text' AND doc_id <> '7' GROUP BY bm.doc_id",
        10,
        "chosen AS (SELECT term FROM bm, nd WHERE field = 'text' AND doc_id = '7' ORDER BY tf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) DESC, term LIMIT 25)",
    ),
    "ngrams": "SELECT p_partkey, CASE WHEN p_name IS NULL THEN NULL WHEN length(p_name) < 3 THEN [] ELSE list_transform(range(1, length(p_name) - 1), lambda i: substring(p_name, i, 3)) END AS grams FROM part",
    "edge_ngrams": "SELECT p_partkey, CASE WHEN p_name IS NULL THEN NULL ELSE list_transform(range(2, least(6, length(p_name)) + 1), lambda i: left(p_name, i)) END AS grams FROM part",
    "shingles": f"WITH t AS (SELECT doc_id, {_TOK} AS t FROM documents) SELECT doc_id, CASE WHEN t IS NULL THEN NULL ELSE list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i+2], ' ')) END AS shingles FROM t",
    "soundex_names": """WITH u AS (SELECT n_name, upper(regexp_replace(n_name, '[^A-Za-z]', '', 'g')) AS up FROM nation),
c AS (SELECT n_name, left(up, 1) AS f, string_split(translate(left(up, 1), 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000000') ||
  replace(translate(substring(up, 2), 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '111122222222334556000000--'), '-', ''), '') AS cs FROM u)
SELECT n_name, CASE WHEN f = '' THEN '' ELSE f || left(array_to_string(list_transform(list_filter(range(2, len(cs) + 1), lambda i: cs[i] <> cs[i-1] AND cs[i] <> '0'), lambda i: cs[i]), '') || '000', 3) END AS code FROM c""",
    "levenshtein_pairs": f"SELECT a, b, CAST(levenshtein(a, b) AS INTEGER) AS value {_NATIONS}",
    "osa_pairs": o.cells(
        "least(m[k - lb] + 1, m[k] + 1, m[k - lb - 1] + CAST(a[i] <> b[j] AS INTEGER), CASE WHEN i > 1 AND j > 1 AND a[i] = b[j - 1] AND a[i - 1] = b[j] THEN m[k - 2 * lb - 3] + 1 ELSE 9999 END)",
        "INTEGER",
        "m[len(m)]",
        _NATIONS,
    ),
    "ngram_similarity_pairs": o.cells(
        "least(m[k - lb] + 1, m[k] + 1, m[k - lb - 1] + (CAST(a[i] <> b[j] AS INTEGER) + CAST(CASE WHEN i > 1 THEN a[i - 1] ELSE '' END <> CASE WHEN j > 1 THEN b[j - 1] ELSE '' END AS INTEGER)) / (CASE WHEN i = 1 AND j = 1 THEN 1 ELSE 2 END))",
        "DOUBLE",
        "round(1 - m[len(m)] / greatest(la, lb), 6)",
        _NATIONS,
    ),
    "jaro_pairs": f"SELECT a, b, round(jaro_similarity(a, b), 6) AS value {_NATIONS}",
    "jaro_winkler_pairs": f"""SELECT a, b, round(CASE WHEN j < 0.7 THEN j ELSE j + least(0.1::DOUBLE, 1.0::DOUBLE / greatest(length(a), length(b))) * p * (1 - j) END, 6) AS value
FROM (SELECT a, b, jaro_similarity(a, b) AS j, length(a) - length(ltrim_same) AS p FROM (
  SELECT a, b, substring(a, 1 + coalesce(list_position(list_transform(range(1, least(length(a), length(b)) + 1), lambda i: a[i] = b[i]), false) - 1, least(length(a), length(b)))::INTEGER) AS ltrim_same {_NATIONS}))""",
    "lev_similarity_pairs": f"SELECT a, b, round(CASE WHEN length(a) = 0 OR length(b) = 0 THEN CAST(length(a) = length(b) AS INTEGER) ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END, 6) AS value {_NATIONS}",
    "wildcard_match_names": "SELECT p_partkey, p_name LIKE '%e_ %a%' AS matches FROM part",
    "upsert_repeated_ids": o.ranked(o.leaf("field = 'text' AND starts_with(term, 'th')"), 0, "", _LAST_CTE + "," + o.index(_LAST, "SELECT doc_id FROM last")),
    "present": """WITH ids AS (SELECT doc_id FROM labels UNION SELECT item_id FROM benchmark), every AS (SELECT doc_id FROM ids WHERE doc_id IS NOT NULL UNION SELECT -doc_id - 1 FROM ids WHERE doc_id IS NOT NULL)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL) AS present FROM every""",
    "parsed_phrase": _phrase("releas", "und", "mit"),
    "parsed_range": _leaf("field = 'text' AND term >= 'thr' AND term < 'ths'"),
    "parsed_group": o.ranked(
        "SELECT g.doc_id, g.score + m.score AS score FROM g JOIN m USING (doc_id)",
        10,
        f"""m AS ({o.leaf("field = 'lang' AND term = 'de'")}), g AS ({o.leaf("field = 'text' AND term IN ('from', 'idiot')")})""",
    ),
    "match_count": f"WITH {o.index()} SELECT count(DISTINCT doc_id) AS total FROM post WHERE field = 'text' AND term = 'from'",
    "match_count_none": "SELECT CAST(0 AS BIGINT) AS total",
    "upsert_delete_search": o.ranked(o.leaf("field = 'text' AND term = 'from'"), 0, "", o.index(_CHANGED, "SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents WHERE source IS DISTINCT FROM 'src1'")),
    "highlight": f"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{Nd}}]+|[^\\p{{L}}\\p{{Nd}}]+') AS ps FROM documents),
u AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM p),
vocab AS (SELECT DISTINCT lower(piece) AS w FROM u), {o.stems('vocab')}
SELECT doc_id, string_agg(CASE WHEN regexp_matches(piece, '^[\\p{{L}}\\p{{Nd}}]') AND (term IN ('from', 'of', 'the', 'und') OR starts_with(lower(piece), 'ste')) THEN '<b>' || piece || '</b>' ELSE piece END, '' ORDER BY i) AS marked
FROM u JOIN stem ON w = lower(piece) GROUP BY doc_id""",
    "stream_changes": f"""WITH last AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, arg_max(event_type, event_id) AS type FROM events GROUP BY user_id),
{o.index({'type': "SELECT doc_id, type AS text FROM last WHERE type <> 'purchase'"}, "SELECT doc_id FROM last WHERE type <> 'purchase'")}
SELECT term AS value, df AS count FROM dict""",
}
