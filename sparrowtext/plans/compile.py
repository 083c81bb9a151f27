"""From a query tree to one plan.

All leaves of the tree share one pass over the postings: each picks its terms from the dictionary, the picked terms are
joined with the postings, and one aggregation by document gives every leaf's score as a column.  Booleans, boosts and the
like are column expressions over those.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import py_lower
from ..functions.similarity import wildcard_regex
from ..operators.index import SearchIndex
from ..operators.query import Bool, Boost, ConstantScore, DisMax, Fuzzy, Leaf, MatchAll, Occur, Phrase, Prefix, Query, Range, Regexp, Term, Terms, Wildcard, java_regexp, leaf_terms
from ..sources.storage import cut

K1, B = 1.2, 0.75
BROADCAST_TERMS = 200_000


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, doc_len: Column, mean: Column, n: Column, df: Column) -> Column:
    """0 for tf 0; lengths don't count if the mean is 0."""
    norm = F.when(mean > 0, doc_len / mean).otherwise(F.lit(0.0))
    below = tf + K1 * (1 - B + B * norm)
    return F.when((tf == 0) | (below == 0), F.lit(0.0)).otherwise(idf(n, df) * (tf * (K1 + 1)) / below)


def leaves(q: Query | None) -> list[Leaf]:
    if q is None or isinstance(q, MatchAll):
        return []
    if isinstance(q, Leaf):
        return [q]
    inner = [x for x, _ in q.clauses] if isinstance(q, Bool) else list(q.queries) if isinstance(q, DisMax) else [q.query]
    return [x for i in inner for x in leaves(i)]


def predicate(q: Leaf, index: SearchIndex) -> Column | None:
    """The terms of the dictionary that a leaf picks; None if it can pick none."""
    term, an = F.col("term"), index.analyzer
    if isinstance(q, Term):
        return term == leaf_terms(q, an)[0]
    if isinstance(q, (Terms, Phrase)):
        terms = leaf_terms(q, an)
        return term.isin(terms) if terms else None
    if isinstance(q, Range):
        bounds = []
        if q.low:
            bounds.append(term >= q.low if q.include_low else term > q.low)
        if q.high:
            bounds.append(term <= q.high if q.include_high else term < q.high)
        return reduce(Column.__and__, bounds, F.lit(True))
    if isinstance(q, Regexp):
        return term.rlike(java_regexp(q.pattern))
    word = py_lower(q.prefix if isinstance(q, Prefix) else q.pattern if isinstance(q, Wildcard) else q.term).strip()
    if not word:
        return None
    if isinstance(q, Prefix):
        return term.startswith(word)
    if isinstance(q, Wildcard):
        return term.rlike(wildcard_regex(word)) & (term.startswith(word.split("*")[0].split("?")[0]))
    edits = max(q.max_edits, 0)
    near = F.abs(F.char_length(term) - len(word)) <= edits
    return near & (F.levenshtein(term, F.lit(word)) <= edits)


_PUSHED = (Term, Terms, Phrase, Prefix, Range)


def _literal(q: Leaf) -> str:
    """What every term that a leaf picks begins with."""
    if isinstance(q, Wildcard):
        return re.split("[*?]", py_lower(q.pattern).strip())[0]
    if isinstance(q, Regexp) and "|" not in q.pattern:
        head = re.match(r"\w*", q.pattern)[0]
        return head if len(head) == len(q.pattern) else head[:-1]  # what follows may repeat the last character
    return ""


def scores(q: Query | None, index: SearchIndex) -> DataFrame:
    """(doc_id, score) of every document that matches."""
    spark = index.documents.sparkSession
    if q is None:
        return spark.createDataFrame([], "doc_id string, score double")
    own = list(dict.fromkeys(leaves(q)))
    picked, scan = [], []
    for i, leaf in enumerate(own):
        p = predicate(leaf, index)
        if p is None:
            continue
        here = (F.col("field") == leaf.name) & p
        rows = index.terms.where(here).select("field", "term", "df")
        if isinstance(leaf, Phrase):
            terms = leaf_terms(leaf, index.analyzer)
            slots = F.map_from_entries(F.array(*[F.struct(F.lit(t), F.array(*[F.lit(k) for k, u in enumerate(terms) if u == t])) for t in dict.fromkeys(terms)]))
            rows = rows.withColumn("slots", slots[F.col("term")])
        else:
            rows = rows.withColumn("slots", F.array(F.lit(0)))
        picked.append(rows.withColumn("leaf", F.lit(i)))
        scan.append(here if isinstance(leaf, _PUSHED) else (F.col("field") == leaf.name) & F.col("term").startswith(_literal(leaf)))
    columns: dict[Leaf, Column] = {}
    base = None
    if picked:
        stats = index.stats
        lengths = stats.mean_length or {"": 0.0}
        mean = F.element_at(F.create_map(*[F.lit(x) for kv in lengths.items() for x in kv]), F.col("field"))
        phrases = [(i, x) for i, x in enumerate(own) if isinstance(x, Phrase)]
        read = ["field", "term", "doc_id", "tf", "doc_len", *(["positions"] if phrases else [])]
        wanted = reduce(DataFrame.unionByName, picked)
        few = all(isinstance(x, (Term, Terms, Phrase)) for x in own)  # as many as the query names
        if not few:
            wanted = cut(wanted)
            few = wanted.count() <= BROADCAST_TERMS
        if few:  # the postings stay where they are, however many a term has
            wanted = F.broadcast(wanted)
        hits = index.postings.where(reduce(Column.__or__, scan)).select(*read).join(wanted, ["field", "term"])
        hits = hits.withColumn("s", bm25(F.col("tf"), F.col("doc_len"), F.coalesce(mean, F.lit(0.0)), F.lit(float(stats.documents)), F.col("df")))
        aggs = []
        for i, leaf in enumerate(own):
            # a phrase counts a term once for each of its places
            aggs.append(F.sum(F.when(F.col("leaf") == i, F.col("s") * F.size("slots"))).alias(f"s{i}"))
            if isinstance(leaf, Phrase):
                for k in range(len(leaf_terms(leaf, index.analyzer))):
                    at = (F.col("leaf") == i) & F.array_contains("slots", k)
                    aggs.append(F.max(F.when(at, F.transform("positions", _less(k)))).alias(f"p{i}_{k}"))
        base = hits.groupBy("doc_id").agg(*aggs)
        for i, leaf in enumerate(own):
            value = F.col(f"s{i}") * leaf.weight
            if isinstance(leaf, Phrase):
                places = [F.col(f"p{i}_{k}") for k in range(len(leaf_terms(leaf, index.analyzer)))]
                common = reduce(F.array_intersect, places) if places else None
                value = F.when(F.size(common) > 0, value) if len(places) > 1 else value if places else F.lit(None).cast("double")
            columns[leaf] = value
    if _needs_all(q):
        base = index.documents if base is None else index.documents.join(base, "doc_id", "left")
    if base is None:
        return spark.createDataFrame([], "doc_id string, score double")
    value = _score(q, {x: columns.get(x, F.lit(None).cast("double")) for x in own})
    return base.select("doc_id", value.alias("score")).where("score is not null")


def _less(k: int) -> Callable[[Column], Column]:
    return lambda p: p - k


def _needs_all(q: Query | None) -> bool:
    if isinstance(q, MatchAll):
        return True
    if q is None or isinstance(q, Leaf):
        return False
    inner = [x for x, _ in q.clauses] if isinstance(q, Bool) else q.queries if isinstance(q, DisMax) else [q.query]
    return any(_needs_all(x) for x in inner)


def _score(q: Query | None, leaf: dict[Leaf, Column]) -> Column:
    """The score of a document, null where it doesn't match."""
    none = F.lit(None).cast("double")
    if q is None:
        return none
    if isinstance(q, MatchAll):
        return F.lit(1.0)
    if isinstance(q, Leaf):
        return leaf[q]
    if isinstance(q, Boost):
        return _score(q.query, leaf) * q.factor
    if isinstance(q, ConstantScore):
        return F.when(_score(q.query, leaf).isNotNull(), F.lit(float(q.score)))
    if isinstance(q, DisMax):
        parts = [_score(x, leaf) for x in q.queries if x is not None]
        if not parts:
            return none
        best = parts[0] if len(parts) == 1 else F.greatest(*parts)
        total = reduce(Column.__add__, [F.coalesce(p, F.lit(0.0)) for p in parts])
        return best + (total - best) * q.tie
    by = {o: [_score(x, leaf) for x, occur in q.clauses if occur == o] for o in Occur}
    scoring = by[Occur.SHOULD] + by[Occur.MUST]
    if not scoring:
        return none
    matches = reduce(Column.__and__, [p.isNotNull() for p in by[Occur.MUST]]) if by[Occur.MUST] else reduce(Column.__or__, [p.isNotNull() for p in scoring])
    for p in by[Occur.MUST_NOT]:
        matches = matches & p.isNull()
    return F.when(matches, reduce(Column.__add__, [F.coalesce(p, F.lit(0.0)) for p in scoring]))
