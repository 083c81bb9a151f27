"""Marking the words of a text that a query finds, by splitting it into words and what is between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.query import Bool, Occur, Phrase, Prefix, Query, Term
from .analysis import STANDARD, Analyzer, lower, py_lower, stem_all

PIECE = r"([\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+)"


@dataclass(frozen=True)
class Highlighter:
    """Wraps words in `before` and `after`.

    Terms, phrases and prefixes count, alone or in booleans outside must-not clauses; with any other query, or none, a
    text stays as it is.  Fields don't count, and every word of a phrase is marked wherever it stands.
    """

    before: str
    after: str
    analyzer: Analyzer = STANDARD

    def wanted(self, q: Query | None) -> tuple[set[str], set[str]]:
        """(terms, prefixes)"""
        if isinstance(q, Term):
            return {self.analyzer.py_term(q.term)}, set()
        if isinstance(q, Phrase):
            return {self.analyzer.py_term(t) for t in q.terms}, set()
        if isinstance(q, Prefix):
            return set(), {py_lower(q.prefix)}
        if isinstance(q, Bool):
            inner = [self.wanted(x) for x, occur in q.clauses if occur != Occur.MUST_NOT]
            return {t for a, _ in inner for t in a}, {p for _, b in inner for p in b}
        return set(), set()

    def highlight(self, text: Column, q: Query | None) -> Column:
        terms, prefixes = self.wanted(q)
        terms.discard("")
        if not terms and not prefixes:
            return text

        pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(1))
        small = F.transform(pieces, lower)

        def mark(piece: Column, of: Column) -> Column:
            word, stem = of["low"], of["stem"]
            hit = F.lit(False)
            if terms:
                hit = hit | stem.isin(sorted(terms))
            for p in sorted(prefixes):
                hit = hit | word.startswith(p)
            return F.when(piece.rlike(r"^[\p{L}\p{Nd}]") & hit, F.concat(F.lit(self.before), piece, F.lit(self.after))).otherwise(piece)

        stems = stem_all(small) if terms and self.analyzer.stemming else small
        return F.array_join(F.zip_with(pieces, F.arrays_zip(small.alias("low"), stems.alias("stem")), mark), "")
