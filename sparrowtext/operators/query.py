"""The query tree: frozen values that print themselves and are compiled by plans.compile."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from enum import IntEnum

from ..errors import SearchError
from ..functions.analysis import Analyzer

DEFAULT_FIELD = "text"


class Occur(IntEnum):
    SHOULD = 0
    MUST = 1
    MUST_NOT = 2


def number(x: float) -> str:
    """The shortest decimal that reads back as x; exponents below -4 and from 6 on are written, with two digits at least."""
    if math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else "+Inf" if x > 0 else "-Inf"
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    digits, exponent = f"{float(x):.17e}".split("e")
    for k in range(17):
        short = f"{float(x):.{k}e}"
        if float(short) == x:
            digits, exponent = short.split("e")
            break
    e = int(exponent)
    if e < -4 or e >= 6:
        return f"{digits}e{'-' if e < 0 else '+'}{abs(e):02d}"
    return f"{float(x):.{max(0, len(digits.replace('-', '').replace('.', '')) - 1 - e)}f}"


def quoted(s: str) -> str:
    """In double quotes, with escapes for quotes, backslashes and what can't be printed."""
    named = {"\a": r"\a", "\b": r"\b", "\f": r"\f", "\n": r"\n", "\r": r"\r", "\t": r"\t", "\v": r"\v", '"': r"\"", "\\": r"\\"}
    out = []
    for c in s:
        cp = ord(c)
        out.append(named.get(c) or (c if c.isprintable() else f"\\x{cp:02x}" if cp < 0x80 else f"\\u{cp:04x}" if cp < 0x10000 else f"\\U{cp:08x}"))
    return '"' + "".join(out) + '"'


@dataclass(frozen=True)
class Query:
    pass


@dataclass(frozen=True)
class Leaf(Query):
    """A query on the dictionary of one field; an empty field is the default one, and a boost of 0 counts as 1."""

    field: str

    @property
    def name(self) -> str:
        return self.field or DEFAULT_FIELD

    @property
    def weight(self) -> float:
        return getattr(self, "boost", 0.0) or 1.0


@dataclass(frozen=True)
class Term(Leaf):
    term: str
    boost: float = 1.0

    def __str__(self) -> str:
        return f"{self.name}:{self.term}"


@dataclass(frozen=True)
class Phrase(Leaf):
    terms: tuple[str, ...]
    boost: float = 1.0

    def __str__(self) -> str:
        return f"{self.name}:{quoted(' '.join(self.terms))}"


@dataclass(frozen=True)
class Prefix(Leaf):
    prefix: str
    boost: float = 1.0

    def __str__(self) -> str:
        return f"{self.name}:{self.prefix}*"


@dataclass(frozen=True)
class Range(Leaf):
    """Terms between two bounds in byte order; an empty bound is open."""

    low: str
    high: str
    include_low: bool = True
    include_high: bool = True
    boost: float = 1.0

    def __str__(self) -> str:
        return f"{self.name}:{'[' if self.include_low else '{'}{self.low or '*'} TO {self.high or '*'}{']' if self.include_high else '}'}"


@dataclass(frozen=True)
class Wildcard(Leaf):
    pattern: str
    boost: float = 1.0

    def __str__(self) -> str:
        return f"{self.name}:{self.pattern}"


@dataclass(frozen=True)
class Regexp(Leaf):
    """A whole term must match.  Constructs that take more than linear time are refused."""

    pattern: str
    boost: float = 1.0

    def __post_init__(self) -> None:
        check_regexp(self.pattern)

    def __str__(self) -> str:
        return f"{self.name}:/{self.pattern}/"


@dataclass(frozen=True)
class Fuzzy(Leaf):
    term: str
    max_edits: int
    boost: float = 1.0

    def __str__(self) -> str:
        return f"{self.name}:{self.term}~{max(self.max_edits, 0)}"


@dataclass(frozen=True)
class Terms(Leaf):
    terms: tuple[str, ...]
    boost: float = 1.0

    def __str__(self) -> str:
        return f"{self.name}:({' '.join(self.terms)})"


@dataclass(frozen=True)
class MatchAll(Query):
    def __str__(self) -> str:
        return "*:*"


@dataclass(frozen=True)
class Bool(Query):
    """Should, must and must-not clauses; without a should or must clause nothing matches."""

    clauses: tuple[tuple[Query, Occur], ...] = ()

    def add(self, query: Query, occur: Occur = Occur.SHOULD) -> Bool:
        return Bool((*self.clauses, (query, occur)))

    def __str__(self) -> str:
        return " ".join(("", "+", "-")[o] + str(q) for q, o in self.clauses)


@dataclass(frozen=True)
class Boost(Query):
    """The inner score times `factor`; boost() takes 0 for 1."""

    query: Query | None
    factor: float

    def __str__(self) -> str:
        return f"({self.query})^{number(self.factor)}"


def boost(query: Query | None, factor: float) -> Boost:
    return Boost(query, factor or 1.0)


@dataclass(frozen=True)
class ConstantScore(Query):
    query: Query | None
    score: float

    def __str__(self) -> str:
        return f"ConstantScore({self.query})^={number(self.score)}"


def constant_score(query: Query | None, score: float) -> ConstantScore:
    return ConstantScore(query, score or 1.0)


@dataclass(frozen=True)
class DisMax(Query):
    """The best score of the clauses and `tie` times the others."""

    queries: tuple[Query | None, ...]
    tie: float

    def __str__(self) -> str:
        return f"({' | '.join(str(q) for q in self.queries if q is not None)})~{number(self.tie)}"


def dis_max(tie: float, *queries: Query | None) -> DisMax:
    return DisMax(queries, min(max(tie, 0.0), 1.0))


_REFUSED = ("(?=", "(?!", "(?<=", "(?<!", "(?>", "\\G", "\\Z", "\\C")


def check_regexp(pattern: str) -> None:
    """Raises where a linear-time engine would: look-around, back-references, possessive repeats, bad syntax."""
    import re

    plain = re.sub(r"\\\\", "", pattern)
    if any(x in plain for x in _REFUSED) or re.search(r"\\[1-9k]", plain) or re.search(r"(?<!\\)[*+?}]\+", re.sub(r"\[[^\]]*\]", "", plain)):
        raise SearchError("regexp", f"unsupported construct in {pattern!r}")
    posix = re.sub(r"\[:\^?\w+:\]", "a", pattern)
    try:
        re.compile(re.sub(r"\\[pP](\{\^?\w+\}|\w)", "a", posix.replace("(?P<", "(?P<").replace(r"\z", r"\Z").replace("(?U)", "")))
    except re.error as e:
        raise SearchError("regexp", f"{pattern!r}: {e}") from e


def java_regexp(pattern: str) -> str:
    """The same expression for the JVM, for a whole term."""
    import re

    out = pattern.replace("(?P<", "(?<")
    for name, java in {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "space": "Space", "punct": "Punct", "xdigit": "XDigit", "cntrl": "Cntrl", "graph": "Graph", "print": "Print", "blank": "Blank"}.items():
        out = out.replace(f"[:{name}:]", f"\\p{{{java}}}").replace(f"[:^{name}:]", f"\\P{{{java}}}")
    return rf"\A(?:{re.sub(r'(?<!\\)\[\[', '[', out) if '[[:' in pattern else out})\z"


def leaf_terms(q: Leaf, analyzer: Analyzer) -> list[str]:
    """The analysed terms of a term, phrase or terms query; empty ones are dropped, and repeated ones only in a phrase kept."""
    raw: Iterable[str] = (q.term,) if isinstance(q, Term) else q.terms  # type: ignore[attr-defined]
    terms = [analyzer.py_term(t) for t in raw]
    if isinstance(q, Term):
        return terms
    terms = [t for t in terms if t]
    return terms if isinstance(q, Phrase) else list(dict.fromkeys(terms))
