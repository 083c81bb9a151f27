import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparrowtext.functions import similarity as sim


@pytest.mark.parametrize(("a", "b", "d"), [("abc", "", 3), ("ab", "ba", 1), ("teh", "the", 1), ("abcd", "acbd", 1), ("kitten", "sitting", 3), ("ca", "abc", 3)])
def test_osa(a, b, d):
    assert sim.py_osa(a, b) == sim.py_osa(b, a) == d


@pytest.mark.parametrize(("a", "b", "j", "w"), [("", "", 1, 1), ("abc", "", 0, 0), ("MARTHA", "MARHTA", 0.944444, 0.961111), ("DWAYNE", "DUANE", 0.822222, 0.84), ("DIXON", "DICKSONX", 0.766667, 0.813333), ("fvie", "ten", 0, 0)])
def test_jaro(a, b, j, w):
    assert sim.py_jaro(a, b) == pytest.approx(j, abs=1e-5)
    assert sim.py_jaro_winkler(a, b) == pytest.approx(w, abs=1e-5)


def test_jaro_winkler_more():
    assert 0.832 < sim.py_jaro_winkler("jones", "johnson") < 0.833
    assert 0.958 < sim.py_jaro_winkler("abcvwxyz", "cabvwxyz") < 0.959


@pytest.mark.parametrize(
    ("a", "b", "values"),
    [("martha", "marhta", (0.6666, 0.6666, 0.7222)), ("jones", "johnson", (0.4285, 0.4285, 0.4762)), ("natural", "contrary", (0.25, 0.25, 0.2083)), ("abcvwxyz", "cabvwxyz", (0.75, 0.625, 0.5625)), ("dwayne", "duane", (0.666, 0.5833, 0.5277)), ("dixon", "dicksonx", (0.5, 0.5, 0.4583))],
)
def test_ngram(a, b, values):
    for n, v in enumerate(values, 1):
        assert sim.py_ngram(a, b, n) == pytest.approx(v, abs=1e-3)
    assert sim.py_ngram("a", "aa", 2) == 0.5


@settings(max_examples=60, deadline=None)
@given(st.text("abcé", max_size=8), st.text("abcé", max_size=8))
def test_symmetry_and_bounds(a, b):
    assert sim.py_osa(a, b) == sim.py_osa(b, a)
    for f in (sim.py_jaro, sim.py_jaro_winkler, sim.py_ngram):
        assert f(a, b) == pytest.approx(f(b, a)) and 0 <= f(a, b) <= 1
    assert sim.py_ngram(a, b, 1) == pytest.approx(1 - _lev(a, b) / max(len(a), len(b)) if a and b else float(a == b))


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_columns(spark):
    rows = [("café", "cafe"), ("", ""), ("", "al"), ("six", "ten"), (None, "a"), ("dixon", "dicksonx")]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(sim.levenshtein(a, b), sim.levenshtein_similarity(a, b), sim.osa(a, b), sim.jaro(a, b), sim.jaro_winkler(a, b), sim.ngram_similarity(a, b, 2)).collect()
    assert [r[0] for r in got] == [1, 0, 2, 3, None, 4]
    assert [r[1] for r in got] == [0.75, 1.0, 0.0, 0.0, None, 0.5]
    assert [r[2] for r in got] == [1, 0, 2, 3, None, 4]
    assert got[4][3] is None and got[5][3] == pytest.approx(0.766667, abs=1e-5) and got[5][5] == 0.5


def test_wildcard(spark):
    cases = {("program", "pro*"): True, ("program", "pr?gram"): True, ("program", "pro"): False, ("a.b", "a?b"): True, ("axb", "a.b"): False, ("", "*"): True, ("x", "?"): True, ("é", "?"): True}
    for (s, p), out in cases.items():
        assert spark.range(1).select(sim.wildcard_match(F.lit(s), p).alias("x")).first().x is out
