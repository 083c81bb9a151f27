"""Ranked search, more-like-this, and the dictionary analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import py_lower
from ..plans.compile import bm25, scores
from ..sources.storage import cut
from .index import SearchIndex
from .parser import Parser
from .query import DEFAULT_FIELD, Query

SOURCE_TERMS = 25


def top(scored: DataFrame, n: int = 0) -> DataFrame:
    """(rank, doc_id, score, total): best first, equal scores by doc_id; all of them if n < 1.  total counts every match."""
    # scores that differ in the last places of a sum are equal
    order = [F.desc(F.round("score", 9)), F.asc("doc_id")]
    if n < 1:
        return _all(scored, order)
    total = scored.agg(F.count("*").alias("total"))
    ranked = scored.orderBy(*order).limit(n).withColumn("rank", F.expr("row_number() over (order by round(score, 9) desc, doc_id)"))
    return ranked.crossJoin(F.broadcast(total)).select("rank", "doc_id", "score", "total")  # total is one row


def _all(scored: DataFrame, order: list[Column]) -> DataFrame:
    """Every match with its rank: partitions of ranges of scores, each in order, and how many rows are before each."""
    at = F.monotonically_increasing_id()  # partition and place in it
    rows = cut(scored.select("doc_id", "score").orderBy(*order).withColumn("_at", at))
    part = F.shiftright("_at", 33)
    sizes = {r.part: r.n for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    before, total = [], 0
    for k in sorted(sizes):
        before += [F.lit(k), F.lit(total)]
        total += sizes[k]
    first = F.create_map(*before)[part] if before else F.lit(0)
    rank = (first + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("int")
    return rows.select(rank.alias("rank"), "doc_id", "score", F.lit(total).cast("bigint").alias("total"))


def count(index: SearchIndex, query: Query | None) -> DataFrame:
    """One row: the number of matches, 0 if there is none."""
    return scores(query, index).agg(F.count("*").alias("total"))


def search(index: SearchIndex, query: Query | None, n: int = 0) -> DataFrame:
    return top(scores(query, index), n)


def search_string(index: SearchIndex, text: str, n: int = 0) -> DataFrame:
    return search(index, Parser(index.analyzer, DEFAULT_FIELD).parse(text), n)


def more_like_this(index: SearchIndex, doc_id: str, field: str, n: int = 0) -> DataFrame:
    """Documents that share the most telling terms of one document, ranked by the sum of their scores."""
    stats = index.stats
    here = index.postings.where(F.col("field") == field)
    # the terms of one document are one row of the forward table, which is ordered by doc_id
    source = index.forward.where((F.col("field") == field) & (F.col("doc_id") == doc_id)).select(F.explode("terms").alias("term"))
    own = source.groupBy("term").agg(F.count("*").alias("tf")).join(index.terms.where(F.col("field") == field).select("term", "df"), "term")
    n_docs = F.lit(float(stats.documents))
    weight = F.col("tf") * F.log1p((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    chosen = own.orderBy(weight.desc(), "term").limit(SOURCE_TERMS).select("term", "df")
    mean = F.lit(stats.mean_length.get(field, 0.0))
    hits = here.where(F.col("doc_id") != doc_id).select("term", "doc_id", "tf", "doc_len").join(F.broadcast(chosen), "term")  # 25 rows at most
    return top(hits.groupBy("doc_id").agg(F.sum(bm25(F.col("tf"), F.col("doc_len"), mean, n_docs, F.col("df"))).alias("score")), n)


def facet_counts(index: SearchIndex, field: str) -> DataFrame:
    """(value, count): documents of each term, most first."""
    return index.terms.where(F.col("field") == field).select(F.col("term").alias("value"), F.col("df").alias("count")).orderBy(F.desc("count"), "value")


def _of_term(index: SearchIndex, field: str, term: str, column: str) -> DataFrame:
    hit = index.terms.where((F.col("field") == field) & (F.col("term") == index.analyzer.py_term(term)))
    return hit.agg(F.coalesce(F.sum(column), F.lit(0)).cast("bigint").alias(column))


def doc_freq(index: SearchIndex, field: str, term: str) -> DataFrame:
    """One row: how many documents hold the term; 0 if none does."""
    return _of_term(index, field, term, "df")


def total_term_freq(index: SearchIndex, field: str, term: str) -> DataFrame:
    """One row: how often the term occurs; 0 if it doesn't."""
    return _of_term(index, field, term, "ttf")


def term_count(index: SearchIndex, field: str) -> DataFrame:
    return index.terms.where(F.col("field") == field).agg(F.count("*").alias("n_terms"))


def terms(index: SearchIndex, field: str) -> DataFrame:
    return index.terms.where(F.col("field") == field).select("term").orderBy("term")


def suggest(index: SearchIndex, field: str, prefix: str, n: int = 0) -> DataFrame:
    """(term, df) of terms with a prefix, in most documents first; nothing for a blank prefix."""
    word = py_lower(prefix).strip()
    found = index.terms.where((F.col("field") == field) & F.col("term").startswith(word) & F.lit(bool(word))).select("term", "df").orderBy(F.desc("df"), "term")
    return found.limit(n) if n > 0 else found


def spell_check(index: SearchIndex, field: str, term: str, max_edits: int, n: int = 0) -> DataFrame:
    """(term, edits, df) of other terms within some edits, nearest first, then in most documents; negative edits count as 1."""
    word, most = py_lower(term).strip(), 1 if max_edits < 0 else max_edits
    near = (F.col("field") == field) & (F.abs(F.col("n_chars") - len(word)) <= most)
    found = index.terms.where(near).withColumn("edits", F.levenshtein("term", F.lit(word))).where((F.col("edits") <= most) & (F.col("term") != word) & F.lit(bool(word)))
    found = found.select("term", "edits", "df").orderBy("edits", F.desc("df"), "term")
    return found.limit(n) if n > 0 else found
