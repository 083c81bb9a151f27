import math

import pytest
from pyspark.sql import functions as F

from sparrowtext.errors import SearchError
from sparrowtext.functions.analysis import Analyzer
from sparrowtext.functions.highlight import Highlighter
from sparrowtext.operators import query as q
from sparrowtext.operators import search as se
from sparrowtext.operators.index import SearchIndex
from sparrowtext.operators.parser import Parser
from sparrowtext.plans.compile import scores
from sparrowtext.sources.storage import documents

ROWS = [
    ("1", "The Go Programming Language", "Go is an open source programming language designed at Google."),
    ("2", "Rust in Action", "Rust is a systems programming language focused on safety."),
    ("3", "Network Programming with Go", "Building network servers and clients using the Go programming language."),
]


@pytest.fixture(scope="module")
def index(spark):
    docs = documents(spark.createDataFrame(ROWS, "id string, title string, body string"), "id", ["title", "body"])
    return SearchIndex.build(docs).save()


def ids(index, query):
    return sorted(r.doc_id for r in scores(query, index).collect())


def by_id(index, query):
    return {r.doc_id: r.score for r in scores(query, index).collect()}


def test_leaves(index):
    assert ids(index, q.Term("body", "rust")) == ["2"]
    assert ids(index, q.Term("body", "programming")) == ["1", "2", "3"]
    assert ids(index, q.Term("body", "the")) == []
    assert ids(index, q.Term("nope", "rust")) == []
    assert ids(index, q.Phrase("body", ("programming", "language"))) == ["1", "2", "3"]
    for terms in (("language", "programming"), ("programming", "zebra"), ()):
        assert ids(index, q.Phrase("body", terms)) == []
    assert ids(index, q.Phrase("body", ("rust",))) == ["2"]
    assert ids(index, q.Prefix("body", " SYS")) == ["2"]
    assert ids(index, q.Prefix("body", "prog")) == ["1", "2", "3"]
    assert ids(index, q.Prefix("body", "programm")) == [] and ids(index, q.Prefix("body", " ")) == []
    assert ids(index, q.Terms("body", ("go", "rust", "go"))) == ["1", "2", "3"]
    assert ids(index, q.Regexp("body", "go")) == ["1", "3"]
    assert ids(index, q.Regexp("body", "prog.*")) == ["1", "2", "3"] and ids(index, q.Regexp("body", "o")) == []
    assert ids(index, q.Wildcard("body", "g?")) == ["1", "3"] and ids(index, q.Wildcard("body", "*ust")) == ["2"]
    assert ids(index, q.Fuzzy("body", "rusk", 1)) == ["2"] and ids(index, q.Fuzzy("body", "rusk", -1)) == []
    for bad in ("(", "(?=a)", r"(a)\1", "a++"):
        with pytest.raises(SearchError) as e:
            q.Regexp("body", bad)
        assert e.value.op == "regexp"


def test_scores(index):
    near = lambda d: {k: pytest.approx(v, abs=1e-6) for k, v in d.items()}
    assert by_id(index, q.Term("body", "go")) == near({"1": 0.470004, "3": 0.444053})
    assert by_id(index, q.Term("body", "rust")) == near({"2": 1.041708})
    assert by_id(index, q.Term("body", "language")) == near({"1": 0.133531, "2": 0.141820, "3": 0.126158})
    assert by_id(index, q.Term("title", "go")) == near({"1": 0.447139, "3": 0.447139})
    go = by_id(index, q.Term("body", "go"))
    assert by_id(index, q.boost(q.Term("body", "go"), 2)) == near({k: 2 * v for k, v in go.items()})
    assert by_id(index, q.boost(q.Term("body", "go"), 0)) == near(go)
    assert by_id(index, q.Boost(q.Term("body", "go"), 0.0)) == {"1": 0.0, "3": 0.0}
    assert by_id(index, q.constant_score(q.Prefix("body", "prog"), 1)) == {"1": 1.0, "2": 1.0, "3": 1.0}
    p, lang = by_id(index, q.Term("body", "programming")), by_id(index, q.Term("body", "language"))
    both = (q.Term("body", "programming"), q.Term("body", "language"))
    assert by_id(index, q.dis_max(0, *both))["1"] == pytest.approx(max(p["1"], lang["1"]))
    assert by_id(index, q.dis_max(7, *both, None))["1"] == pytest.approx(p["1"] + lang["1"])
    twice = by_id(index, q.Phrase("body", ("programming", "language")))
    assert twice["1"] == pytest.approx(p["1"] + lang["1"])


def test_booleans(index):
    t = lambda x: q.Term("body", x)
    must, no = q.Occur.MUST, q.Occur.MUST_NOT
    assert ids(index, q.Bool().add(t("programming"), must).add(t("rust"), must)) == ["2"]
    assert ids(index, q.Bool().add(t("programming")).add(t("rust"), no)) == ["1", "3"]
    assert ids(index, q.Bool().add(t("rust")).add(t("google"))) == ["1", "2"]
    assert ids(index, q.Bool().add(t("rust"), no)) == [] and ids(index, q.Bool()) == []
    assert ids(index, q.MatchAll()) == ["1", "2", "3"]
    assert ids(index, q.Bool().add(q.MatchAll(), must).add(t("rust"), no)) == ["1", "3"]
    assert ids(index, q.Boost(None, 2.0)) == [] and ids(index, None) == []


def test_ranges_and_ties(spark):
    bare = Analyzer.of(stemming=False)
    years = SearchIndex.build(documents(spark.createDataFrame([("a", "2001"), ("b", "2010"), ("c", "2020")], "id string, year string"), "id", ["year"]), bare)
    assert ids(years, q.Range("year", "2005", "2015")) == ["b"]
    assert ids(years, q.Range("year", "2001", "2020", False, False)) == ["b"]
    assert ids(years, q.Range("year", "2010", "")) == ["b", "c"]
    assert ids(years, q.Range("nope", "", "")) == []
    same = SearchIndex.build(documents(spark.createDataFrame([(x, "same content here") for x in "zamb"], "id string, body string"), "id", ["body"]), bare)
    got = se.search(same, q.Term("body", "content"), 2).collect()
    assert [(r["rank"], r.doc_id, r.total) for r in got] == [(1, "a", 4), (2, "b", 4)]


def test_analytics(index):
    facets = [(r.value, r["count"]) for r in se.facet_counts(index, "title").collect()]
    assert len(facets) == 6 and facets[:2] == [("go", 2), ("program", 2)] and facets[2:] == sorted(facets[2:])
    assert se.doc_freq(index, "body", "programming").first().df == 3 and se.doc_freq(index, "body", "x").first().df == 0
    assert se.total_term_freq(index, "body", "go").first().ttf == 2
    assert se.term_count(index, "title").first().n_terms == 6
    assert [r.term for r in se.suggest(index, "body", "prog").collect()] == ["program"] and se.suggest(index, "body", " ").count() == 0
    assert "program" in [r.term for r in se.spell_check(index, "body", "programm", 1).collect()]
    assert "google" not in [r.term for r in se.spell_check(index, "body", "google", 1).collect()]
    like = se.more_like_this(index, "1", "body").collect()
    assert [r.total for r in like] == [2, 2] and like[0].doc_id == "3"
    assert se.more_like_this(index, "1", "body", 1).count() == 1 and se.more_like_this(index, "9", "body").count() == 0
    assert index.field_names() == ["body", "title"]
    assert [r.doc_id for r in se.search_string(index, "go").collect()] == []
    assert [(r.doc_id, r.total) for r in se.search(index, Parser().parse("body:go")).collect()] == [("1", 2), ("3", 2)]
    assert sorted(r.doc_id for r in se.search(index, Parser().parse("body:programming +body:go -rust")).collect()) == ["1", "3"]


def test_changes(spark, index):
    new = documents(spark.createDataFrame([("2", "Python", "Python is a language")], "id string, title string, body string"), "id", ["title", "body"])
    changed = index.add(new)
    assert changed.documents.count() == 3 and ids(changed, q.Term("body", "rust")) == [] and ids(changed, q.Term("body", "python")) == ["2"]
    gone = index.delete(spark.createDataFrame([("1",), ("1",), ("7",)], "doc_id string"))
    assert gone.documents.count() == 2 and not gone.has("1") and gone.has("2") and ids(gone, q.Term("body", "google")) == []
    all_gone = index.delete(index.documents)
    assert all_gone.field_names() == ["body", "title"] and ids(all_gone, q.MatchAll()) == []
    seq = spark.createDataFrame([("1", {"f": "old"}, 1), ("1", {"f": "new"}, 2), ("2", {}, 3), ("3", {"f": "the"}, 4)], "doc_id string, fields map<string,string>, seq int")
    made = SearchIndex.build(seq, sequence="seq")
    assert ids(made, q.Term("f", "old")) == [] and ids(made, q.Term("f", "new")) == ["1"] and ids(made, q.MatchAll()) == ["1", "2", "3"]
    assert [(r.n_docs, r.total_len) for r in made.field_stats().collect()] == [(2, 1)]
    for bad in [("", {"f": "x"}), (None, {"f": "x"}), ("1", None)]:
        with pytest.raises(Exception, match="add"):
            SearchIndex.build(spark.createDataFrame([bad], "doc_id string, fields map<string,string>")).documents.collect()


def test_batch_and_empty(spark):
    many = spark.range(50).select(F.col("id").cast("string").alias("doc_id"), F.create_map(F.lit("f"), F.lit("word")).alias("fields"))
    assert SearchIndex.build(many).documents.count() == 50
    none = SearchIndex.build(many.limit(0))
    assert ids(none, q.Term("f", "word")) == [] and ids(none, q.MatchAll()) == []


def test_parser_shapes():
    p = lambda s: Parser(default_field="text").parse(s)
    t = lambda w, f="text": q.Term(f, w)
    s, must, no = q.Occur.SHOULD, q.Occur.MUST, q.Occur.MUST_NOT
    b = lambda *c: q.Bool(tuple(c))
    table = {
        "": q.MatchAll(), "go": t("go"), "title:go": t("go", "title"), '"a b"': q.Phrase("text", ("a", "b")), "+a -b c": b((t("a"), must), (t("b"), no), (t("c"), s)),
        "net *": q.Prefix("text", "net"), "foo : bar": t("bar", "foo"), "foo: bar": t("bar", "foo"), "*": q.MatchAll(), "*:*": q.MatchAll(), "]": q.MatchAll(), ":": q.MatchAll(),
        "*:* -foo": b((t("foo"), no)), "n*t": b((q.Prefix("text", "n"), s), (t("t"), s)), "full-text": b((t("full"), s), (t("text"), no)), "title:(a b)": b((t("a"), s), (t("b"), s)),
        "title:-go": t("go"), "+-go": t("go"), "--go": t("go"), "title:": q.MatchAll(), "() foo bar": t("bar"), "a:b:c": b((t("b", "a"), s), (t("c"), s)), '""': q.Phrase("text", ()),
        "go^2": t("go^2"), "go~1": t("go~1"), "a AND b": b((t("a"), s), (t("AND"), s), (t("b"), s)), "+x": b((t("x"), must)),
        "[A to B]": q.Range("text", "a", "b"), "year:{* TO 5}": q.Range("year", "", "5", False, False), "[a TO b}": q.Range("text", "a", "b", True, False),
    }
    for text, tree in table.items():
        assert p(text) == tree, text
    for bad in ('"open', "[2001 TO 2020", "[2001 2020]", "go )", "(go", "[* *]", "(()) x", "[-5 TO 5]", "[a* TO z]", '["a" TO z]', "[", "[a TO"):
        with pytest.raises(SearchError) as e:
            p(bad)
        assert e.value.op == "parse", bad


def test_printing():
    assert [str(x) for x in (q.Term("", "x"), q.Prefix("body", "net"), q.Range("year", "2001", "2020", True, False), q.Range("year", "", "", False, True), q.MatchAll())] == ["text:x", "body:net*", "year:[2001 TO 2020}", "year:{* TO *]", "*:*"]
    assert str(q.boost(q.Term("text", "go"), 2)) == "(text:go)^2" and str(q.Regexp("body", "o")) == "body:/o/" and str(q.Phrase("b", ('a"', "é"))) == 'b:"a\\" é"'
    assert str(q.dis_max(0.5, q.Term("a", "b"), q.Term("c", "d"))) == "(a:b | c:d)~0.5" and str(q.constant_score(q.Term("a", "b"), 1)) == "ConstantScore(a:b)^=1"
    assert str(q.Bool().add(q.Term("a", "b"), q.Occur.MUST).add(q.Term("a", "c"), q.Occur.MUST_NOT).add(q.Fuzzy("a", "d", -1))) == "+a:b -a:c a:d~0"
    assert [q.number(x) for x in (2, 0.1, 1e21, 1e-5, 1.5e-7, 123456789.25, 0, -2.5, math.inf)] == ["2", "0.1", "1e+21", "1e-05", "1.5e-07", "1.2345678925e+08", "0", "-2.5", "+Inf"]


def test_highlight(spark):
    h = Highlighter("<b>", "</b>")
    mark = lambda text, query, x=h: spark.range(1).select(x.highlight(F.lit(text), query).alias("x")).first().x
    assert mark("Go is a programming language.", q.Term("x", "programming")) == "Go is a <b>programming</b> language."
    assert mark("He programs daily.", q.Term("x", "program")) == "He <b>programs</b> daily."
    assert mark("a network of programming", q.Phrase("x", ("network", "programming"))) == "a <b>network</b> of <b>programming</b>"
    assert mark("networking", q.Prefix("x", "NET")) == "<b>networking</b>"
    assert mark("rust go", q.Bool().add(q.Term("x", "rust"), q.Occur.MUST_NOT).add(q.Term("x", "go"))) == "rust <b>go</b>"
    assert mark("go", None) == "go" and mark("go", q.Range("x", "a", "z")) == "go" and mark("go", q.boost(q.Term("x", "go"), 2)) == "go"
    assert mark("go, go! née-go", q.Term("x", "go"), Highlighter("<", ">")) == "<go>, <go>! née-<go>"
    assert mark("a the", q.Term("x", "the")) == "a <b>the</b>" and mark("a b", q.Prefix("x", "")) == "<b>a</b> <b>b</b>"


def test_stream(spark, tmp_path):
    from sparrowtext.streaming.maintain import Maintainer

    start = SearchIndex.build(spark.createDataFrame([("1", {"f": "alpha"}), ("2", {"f": "beta"})], "doc_id string, fields map<string,string>"))
    schema = "op string, doc_id string, fields map<string,string>, seq bigint"
    changes = [("delete", "1", None, 1), ("add", "3", {"f": "gamma"}, 2), ("add", "2", {"f": "delta"}, 3), ("add", "2", {"f": "epsilon"}, 4)]
    spark.createDataFrame(changes, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    keeper = Maintainer(start)
    stream = keeper.start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "state"))
    stream.processAllAvailable()
    stream.stop()
    assert ids(keeper.index, q.MatchAll()) == ["2", "3"] and ids(keeper.index, q.Prefix("f", "e")) == ["2"] and ids(keeper.index, q.Terms("f", ("alpha", "delta"))) == []
    batch = max(keeper.versions())
    before = keeper.index
    keeper.merge(spark.createDataFrame([("add", "9", {"f": "new"}, 9)], schema), batch + 1)
    keeper.merge(spark.createDataFrame([("add", "9", {"f": "new"}, 9)], schema), batch + 1)
    assert keeper.index.documents.count() == before.documents.count() + 1


def test_repeated_ids(spark):
    rows = [("1", "alpha beta", 1), ("1", "alpha gamma", 2), ("2", "alpha", 1), ("1", "delta", 0)]
    docs = documents(spark.createDataFrame(rows, "id string, body string, seq int"), "id", ["body"], "seq")
    last = SearchIndex.build(docs, sequence="seq")
    assert last.documents.count() == 2 and ids(last, q.Term("body", "gamma")) == ["1"] and ids(last, q.Term("body", "delta")) == []
    greatest = SearchIndex.build(docs.repartition(3))
    assert greatest.documents.count() == 2 and ids(greatest, q.Term("body", "delta")) == ["1"]
    assert greatest.postings.where("term = 'alpha'").count() == 1
    more = last.add(docs.where("doc_id = '2'").union(docs.where("doc_id = '1'")), "seq")
    assert more.documents.count() == 2 and ids(more, q.Term("body", "beta")) == []
    asked = spark.createDataFrame([("1",), ("3",), ("1",)], "doc_id string")
    assert sorted((r.doc_id, r.present) for r in last.present(asked).collect()) == [("1", True), ("3", False)]


def test_all_ranks(spark, index):
    from sparrowtext.operators.search import top

    scored = spark.range(2000).select(F.col("id").cast("string").alias("doc_id"), (F.col("id") % 7).cast("double").alias("score")).repartition(5)
    got = sorted(top(scored).collect(), key=lambda r: r["rank"])
    want = sorted(((i % 7, str(i)) for i in range(2000)), key=lambda x: (-x[0], x[1]))
    assert [(r.score, r.doc_id) for r in got] == want and [r["rank"] for r in got] == list(range(1, 2001)) and {r.total for r in got} == {2000}
    assert top(scored.limit(0)).collect() == []
    assert se.count(index, q.Term("body", "zebra")).first().total == 0 and se.count(index, q.MatchAll()).first().total == 3


def test_literal_beginnings(index):
    from sparrowtext.plans.compile import _literal

    assert [_literal(x) for x in (q.Wildcard("b", "Pro*m"), q.Wildcard("b", "*x"), q.Regexp("b", "prog.*"), q.Regexp("b", "go"), q.Regexp("b", "go*d"), q.Regexp("b", "a|b"), q.Fuzzy("b", "go", 1))] == ["pro", "", "pro", "go", "g", "", ""]
    both = q.Bool().add(q.Term("body", "rust")).add(q.Wildcard("body", "g?")).add(q.Regexp("body", "goo.*")).add(q.Fuzzy("body", "saftey", 2))
    assert ids(index, both) == ["1", "2", "3"]


def test_versions_survive(spark, tmp_path):
    from sparrowtext.streaming.maintain import Maintainer, empty_index

    changes = lambda *rows: spark.createDataFrame([(op, i, {"body": t}, k) for k, (op, i, t) in enumerate(rows)], "op string, doc_id string, fields map<string,string>, seq int")
    one = changes(("add", "a", "first words"), ("add", "b", "second words"))
    keeper = Maintainer(empty_index(one), path=f"{tmp_path}/versions")
    keeper.merge(one, 0)
    keeper.merge(changes(("delete", "a", ""), ("add", "c", "third")), 1)
    again = Maintainer(empty_index(one), path=f"{tmp_path}/versions")
    assert ids(again.index, q.MatchAll()) == ["b", "c"]
    again.merge(changes(("delete", "a", ""), ("add", "c", "third")), 1)
    assert ids(again.index, q.MatchAll()) == ["b", "c"] and ids(again.before(1), q.MatchAll()) == ["a", "b"]
