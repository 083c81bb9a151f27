"""Text analysis as column expressions: tokens, stop words, stems, and n-grams of several kinds.

Everything but the terms of whole texts is built from functions that run inside the JVM.  The stem of a single word is one chain
of replacements in which each step refers to the step before it once; branches that mention a step several times would
be multiplied by the optimizer.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = tuple(
    "a an as at be by if in is it no of on or to and are but for not the was into such that then they this will with their there these".split()
)
KNOWN_WORDS = 1 << 19  # words whose stems a worker keeps
PART_BYTES = 4 << 20  # of the texts that are split at once
TOKEN = r"[\p{L}\p{Nd}]+"

_M = "\x01"
_DROPPED = "able ance ant ence ent er ful ible ity ive ize ly ment ness or ous".split()
_TRIMMED = "tional:tion fulness:ful ousness:ous iveness:ive alize:al icate:ic iciti:ic ical:ic".split()
_SUFFIXES = ["ational", *[x.split(":")[0] for x in _TRIMMED[:4]], "ization", *[x.split(":")[0] for x in _TRIMMED[4:]], *_DROPPED]
_KEPT = "|".join(f"({b}){a[len(b):]}" for a, b in (x.split(":") for x in _TRIMMED))
_REST = "|".join(_DROPPED)
_VC = "[aeiou][^aeiou]"

_ENDINGS = "|".join(sorted({x[-2:] for x in _SUFFIXES}))


def _if_ends(*ends: str) -> str:
    """Fails at once where the word ends otherwise; without it the pattern behind would try every way to split."""
    return f"^(?=.*+(?:{'|'.join(f'(?<={e})' for e in ends)}))"


_IF_MARKED = f"^(?=[^{_M}]*+{_M})"

#: (pattern, replacement) one after the other; the mark stands where a suffix was cut off
STEPS = (
    (r"(?:(?<=ss)es|(?<=i)es|(?<!s)s)$", ""),
    (rf"{_if_ends('eed')}(.*{_VC}.*)eed$", "$1ee"),
    (rf"{_if_ends('ed', 'ing')}(.*[aeiou].*)(?:(?<!e)ed|ing)$", f"$1{_M}"),
    (rf"(at|bl|iz){_M}$", "$1e"),
    (rf"([b-df-hjkmnp-rtv-y0-9])\1{_M}$", "$1"),
    (rf"{_M}$", ""),
    (rf"{_if_ends(_ENDINGS)}(.*?)({'|'.join(_SUFFIXES)})$", f"$1{_M}$2"),
    (rf"{_IF_MARKED}(.*{_VC}.*){_M}(?:(at)ional|(iz)ation)$", "$1$2$3e"),
    (rf"{_IF_MARKED}(.*{_VC}.*){_M}(?:{_KEPT}|{_REST})$", "$1$2$3$4$5$6$7$8$9"),
    (_M, ""),
    (rf"{_if_ends('e')}(.*{_VC}.*{_VC}.*)e$", "$1"),
)

_PY_STEPS = tuple((re.compile(pattern), re.sub(r"\$(\d)", r"\\\1", by)) for pattern, by in STEPS)
#: a word that ends otherwise, or for None one without the mark, isn't changed by the step
_PY_ENDS = ("s", "eed", ("ed", "ing"), _M, _M, _M, tuple(_SUFFIXES), None, None, None, "e")


def lower(text: Column) -> Column:
    """Lower case of each character by itself: no final sigma, no dotted i of two characters."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def tokenize(text: Column) -> Column:
    """Maximal runs of letters and decimal digits, as an array; combining marks and underscores separate."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def stem(word: Column) -> Column:
    """The stem of a lower-cased word; words of at most three bytes stay."""
    out = word
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by)
    return F.when(F.octet_length(word) <= 3, word).otherwise(out)


def _stems(words: pa.Array) -> pa.Array:
    """The stems of lists of words: each distinct word of the batch once."""
    flat = words.flatten().dictionary_encode()
    stems = pa.array([w if w is None else py_stem(w) for w in flat.dictionary.to_pylist()], pa.string()).take(flat.indices)
    ends = np.cumsum(np.append(0, pc.fill_null(words.value_lengths(), 0).to_numpy(zero_copy_only=False)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), stems, mask=words.is_null())


def _terms(text: pa.Array, stops: frozenset[str]) -> pa.Array:
    """The stems of the words of texts that aren't stop words: each distinct word once."""
    words = pc.split_pattern_regex(pc.utf8_lower(text.cast(pa.string())), r"[^\p{L}\p{Nd}]+")  # empty at an edge that is no word
    flat = words.flatten().dictionary_encode()
    stems = [py_stem(w) if w and w not in stops else None for w in flat.dictionary.to_pylist()]
    codes = flat.indices.to_numpy()
    kept = np.array([s is not None for s in stems], bool)[codes]
    ends = np.cumsum(np.append(0, pc.fill_null(words.value_lengths(), 0).to_numpy(zero_copy_only=False)))
    ends = np.append(0, np.cumsum(kept))[ends]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(stems, pa.string()).take(pa.array(codes[kept])), mask=text.is_null())


def stem_all(words: Column) -> Column:
    """The stems of an array of lower-cased words.

    A batch goes through Arrow, and each of its distinct words through the steps, once as long as a worker knows it: most words
    of a text were met before, so that this takes a fraction of the time of the steps over every word inside the JVM.
    """
    return F.arrow_udf(_stems, "array<string>")(words)


def py_lower(s: str) -> str:
    return "".join({"İ": "i", "Σ": "σ"}.get(c, c.lower() if len(c.lower()) == 1 else c) for c in s)


@lru_cache(KNOWN_WORDS)
def py_stem(word: str) -> str:
    if len(word.encode()) <= 3:
        return word
    for (pattern, by), ends in zip(_PY_STEPS, _PY_ENDS, strict=True):
        if word.endswith(ends) if ends else _M in word:
            word = pattern.sub(by, word, count=1)
    return word


def py_tokenize(text: str) -> list[str]:
    out, run = [], []
    for c in [*text, " "]:
        if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd":
            run.append(c)
        elif run:
            out.append("".join(run))
            run = []
    return out


@dataclass(frozen=True)
class Analyzer:
    """How text becomes terms.  The default removes English stop words and stems."""

    stop_words: frozenset[str] = field(default_factory=lambda: frozenset(STOP_WORDS))
    stemming: bool = True

    @classmethod
    def of(cls, stop_words: Iterable[str] = (), stemming: bool = True) -> Analyzer:
        """Without arguments: lower case and stems, no stop words.  Stop words are lower-cased."""
        return cls(frozenset(py_lower(w) for w in stop_words), stemming)

    def words(self, text: Column) -> Column:
        """The tokens that survive, in order, lower-cased and not yet stemmed."""
        out = tokenize(lower(text))
        if self.stop_words:
            stops = F.array(*[F.lit(w) for w in sorted(self.stop_words)])
            out = F.filter(out, lambda w: ~F.array_contains(stops, w)) if len(self.stop_words) > 500 else F.filter(out, lambda w: ~w.isin(sorted(self.stop_words)))
        return out

    def stemmed(self, word: Column) -> Column:
        return stem(word) if self.stemming else word

    def terms(self, text: Column) -> Column:
        """Array of terms; a term's index is its position."""
        if not self.stemming:
            return self.words(text)
        stops = self.stop_words

        def terms(text: pa.Array) -> pa.Array:
            rows = max(1, len(text) * PART_BYTES // max(text.nbytes, 1))
            out = [_terms(text.slice(k, rows), stops) for k in range(0, len(text), rows)]
            return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))

        return F.arrow_udf(terms, "array<string>")(text)

    def analyze(self, text: Column) -> Column:
        """Array of (term, pos)."""
        return F.transform(self.terms(text), lambda t, i: F.struct(t.alias("term"), i.alias("pos")))

    def term(self, term: Column) -> Column:
        """A query term of a column: trimmed, lower-cased and stemmed, neither split nor stopped."""
        return self.stemmed(lower(F.regexp_replace(term, r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", "")))

    def py_term(self, term: str) -> str:
        word = py_lower(term.strip())
        return py_stem(word) if self.stemming else word

    def py_terms(self, text: str) -> list[str]:
        words = [w for w in map(py_lower, py_tokenize(text)) if w not in self.stop_words]
        return [py_stem(w) for w in words] if self.stemming else words


STANDARD = Analyzer()


def _none() -> Column:
    return F.array().cast("array<string>")


def ngrams(s: Column, n: int) -> Column:
    """All substrings of n characters; none if n < 1 or the string is shorter."""
    if n < 1:
        return F.when(s.isNotNull(), _none())
    return F.when(F.char_length(s) >= n, F.transform(F.sequence(F.lit(1), F.char_length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n)))).when(s.isNotNull(), _none())


def edge_ngrams(s: Column, least: int, most: int) -> Column:
    """Prefixes of `least` to `most` characters; a least below 1 counts as 1."""
    least = max(least, 1)
    if most < least:
        return F.when(s.isNotNull(), _none())
    size = F.least(F.lit(most), F.char_length(s))
    return F.when(size >= least, F.transform(F.sequence(F.lit(least), size), lambda k: F.substring(s, F.lit(1), k))).when(s.isNotNull(), _none())


def shingles(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by a space; an n below 1 counts as 2."""
    n = n if n >= 1 else 2
    runs = lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))).when(t.isNotNull(), _none())
    return F.get(F.transform(F.array(tokens), runs), F.lit(0))  # the tokens are worked out once


def soundex(s: Column) -> Column:
    """American Soundex of the ASCII letters of s; empty if it has none."""
    return F.soundex(F.regexp_replace(s, "[^A-Za-z]", ""))
