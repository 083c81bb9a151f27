"""What the index, its searches and its changes exchange between partitions."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparrowtext.functions import analysis as an
from sparrowtext.operators import index as ix
from sparrowtext.operators import query as q
from sparrowtext.operators.index import SearchIndex
from sparrowtext.plans import compile as co

TEXTS = {f"d{i}": {"f": " ".join(f"w{(i * j) % 7} Größen the agreed{j % 3}" for j in range(i % 5 + 1)), "g": "É1 ²x İstanbul" if i % 2 else ""} for i in range(60)}
ix_schema = pa.schema([("field", pa.string()), ("doc_id", pa.string()), ("terms", pa.list_(pa.string())), ("doc_len", pa.int32())])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id string, fields map<string,string>").repartition(3).localCheckpoint()


def wanted():
    want = {}
    for i, fields in TEXTS.items():
        for f, text in fields.items():
            terms = an.STANDARD.py_terms(text)
            for t, n in Counter(terms).items():
                want[f, t, i] = (n, [k for k, x in enumerate(terms) if x == t], len(terms))
    return want


def test_postings_are_not_exchanged(docs):
    built = SearchIndex.build(docs)
    assert "Exchange" not in plan(built.postings)
    for made in (built, SearchIndex.build(docs).save(), SearchIndex.build(docs.limit(0)).save()):
        rows = made.postings.collect()
        got = {(r.field, r.term, r.doc_id): (r.tf, r.positions, r.doc_len) for r in rows}
        assert len(got) == len(rows) and got == (wanted() if made.documents.count() else {})


def test_runs(monkeypatch):
    rows = [(f, i, an.STANDARD.py_terms(text)) for i, fields in TEXTS.items() for f, text in fields.items()]
    batch = pa.RecordBatch.from_pylist([{"field": f, "doc_id": i, "terms": t, "doc_len": len(t)} for f, i, t in rows], ix_schema)
    monkeypatch.setattr(ix, "RUN_TERMS", 40)
    monkeypatch.setattr(ix, "RUN_ROWS", 7)
    made = list(ix._postings(batch.slice(k, 5) for k in range(0, len(rows), 5)))
    got = [r for b in made for r in b.to_pylist()]
    assert max(b.num_rows for b in made) == 7 and len(got) == len(wanted())
    assert {(r["field"], r["term"], r["doc_id"]): (r["tf"], r["positions"], r["doc_len"]) for r in got} == wanted()


def test_runs_stay_in_order(docs, spark):
    saved = SearchIndex.build(docs.coalesce(1)).save()
    rows = [(r.term, r.doc_id) for r in saved.postings.where("field = 'f'").collect()]
    assert rows == sorted(rows) and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_found_postings_are_not_exchanged(docs, spark, monkeypatch):
    saved, query = SearchIndex.build(docs).save(), q.Bool().add(q.Range("f", "w1", "w4")).add(q.Prefix("f", "w6"), q.Occur.MUST_NOT)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = co.scores(query, saved)
        assert "SortMergeJoin" not in plan(found)
        got = {r.doc_id: r.score for r in found.collect()}
        monkeypatch.setattr(co, "BROADCAST_TERMS", 2)
        other = co.scores(query, saved)
        assert "SortMergeJoin" in plan(other) and got and {r.doc_id: r.score for r in other.collect()} == pytest.approx(got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_last_of_many_moves_no_text(spark, monkeypatch):
    rows = [(str(i % 4), {"f": f"text{i}"}, None if i < 8 else i // 8) for i in range(64)] + [("x", {"f": "a"}, None), ("x", {"f": "b"}, None), ("y", {"f": "c"}, 3)]
    many = spark.createDataFrame(rows, "doc_id string, fields map<string,string>, seq int").repartition(5).localCheckpoint()
    want = {"0": "text60", "1": "text61", "2": "text62", "3": "text63", "x": "b", "y": "c"}
    for most in (ix.BROADCAST_IDS, 1):
        monkeypatch.setattr(ix, "BROADCAST_IDS", most)
        last = ix._latest(many, "seq")
        assert "Window" not in plan(last) and {r.doc_id: r.fields["f"] for r in last.collect()} == want
        assert last.count() == 6
    monkeypatch.undo()
    assert "Exchange hash" not in plan(ix._latest(many, "seq"))
    only = many.where(F.col("doc_id") < "4")
    assert {r.doc_id for r in ix._latest(only, None).collect()} == {"0", "1", "2", "3"}
