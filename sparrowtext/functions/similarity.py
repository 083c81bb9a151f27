"""String similarity over code points.

Levenshtein runs in the JVM.  The others have no counterpart there and run as Arrow-batched functions, on
distinct pairs of a batch only.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty strings are alike, one is not."""
    la, lb = F.char_length(a), F.char_length(b)
    ratio = 1 - F.levenshtein(a, b).cast("double") / F.greatest(la, lb, F.lit(1))
    return F.when((la == 0) | (lb == 0), F.when(la == lb, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(ratio)


def py_osa(a: str, b: str) -> int:
    """Edits with swaps of neighbours, no substring being edited twice."""
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


def py_jaro(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                left.append(x)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [y for y, f in zip(b, free, strict=True) if not f]
    swapped = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def py_jaro_winkler(a: str, b: str) -> float:
    """Jaro, raised by the whole common prefix where it is at least 0.7."""
    jaro = py_jaro(a, b)
    if jaro < 0.7:
        return jaro
    same = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        same += 1
    return jaro + min(0.1, 1 / max(len(a), len(b), 1)) * same * (1 - jaro)


def py_ngram(a: str, b: str, n: int = 2) -> float:
    """Edit distance of the n-grams that end at each character, as a similarity; n below 1 counts as 1.

    Grams reach over the start into padding, and padding that agrees counts neither as a match nor as a difference.
    """
    n = max(n, 1)
    if not a or not b:
        return float(a == b)
    longest = max(len(a), len(b))
    if min(len(a), len(b)) < n:
        return sum(x == y for x, y in zip(a, b, strict=False)) / longest
    pad = "\0" * (n - 1)
    u, v = pad + a, pad + b
    above = [float(i) for i in range(len(a) + 1)]
    for j in range(len(b)):
        gram = v[j : j + n]
        row = [j + 1.0]
        for i in range(len(a)):
            other = u[i : i + n]
            differ = sum(x != y for x, y in zip(other, gram, strict=True))
            counted = n - sum(x == y == "\0" for x, y in zip(other, gram, strict=True))
            row.append(min(row[-1] + 1, above[i + 1] + 1, above[i] + differ / counted))
        above = row
    return 1 - above[-1] / longest


def _udf(f: Callable, kind: T.DataType) -> Callable[[Column, Column], Column]:
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple, object] = {}
        out = []
        for pair in zip(a, b, strict=True):
            if pair not in known:
                known[pair] = None if pair[0] is None or pair[1] is None else f(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(over, kind)


def osa(a: Column, b: Column) -> Column:
    return _udf(py_osa, T.IntegerType())(a, b)


def jaro(a: Column, b: Column) -> Column:
    return _udf(py_jaro, T.DoubleType())(a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    return _udf(py_jaro_winkler, T.DoubleType())(a, b)


def ngram_similarity(a: Column, b: Column, n: int = 2) -> Column:
    return _udf(lambda x, y: py_ngram(x, y, n), T.DoubleType())(a, b)


def wildcard_regex(pattern: str) -> str:
    """An anchored regular expression: * is any run of characters, ? any one character."""
    special = set(r"\.[]{}()+-^$|&~#")
    return r"\A(?s:" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in special else c for c in pattern) + r")\z"


def wildcard_match(s: Column, pattern: str) -> Column:
    return s.rlike(wildcard_regex(pattern))
