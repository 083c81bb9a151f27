"""The inverted index: ordinary tables, made and changed by declarative plans.

documents(doc_id), forward(field, doc_id, terms, doc_len), postings(field, term, doc_id, tf, positions, doc_len),
terms(field, term, df, ttf, n_chars) and fields(field).  A field stays listed once a document had it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException as SparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SearchError
from ..functions.analysis import STANDARD, Analyzer
from ..sources.storage import cut, new_folder

TABLES = ("documents", "forward", "postings", "terms", "fields")
RUN_TERMS = 1 << 20  # terms of the texts whose postings are sorted together
RUN_ROWS = 1 << 16  # postings handed to the JVM at once
OPEN_FILES = 16  # fields whose files a task writes side by side; a task with more sorts the rest
BROADCAST_IDS = 200_000
_POSTINGS = "field string, term string, doc_id string, tf int, positions array<int>, doc_len int"


@dataclass(frozen=True)
class Stats:
    """Live documents, and for each field its documents and the mean number of terms."""

    documents: int
    mean_length: dict[str, float]


@dataclass(frozen=True)
class SearchIndex:
    analyzer: Analyzer
    documents: DataFrame
    forward: DataFrame
    postings: DataFrame
    terms: DataFrame
    fields: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, analyzer: Analyzer | None = None, sequence: str | None = None) -> SearchIndex:
        """An index of (doc_id, fields); of rows that share a doc_id the last by `sequence` counts.

        Rows have no order of their own, so without `sequence`, and of rows that tie, the one whose fields are the greatest as JSON counts.
        Rows without doc_id, with an empty one or without fields are an error of the op `add`, found when the plan runs.
        """
        analyzer = analyzer or STANDARD
        return cls._build(_latest(_checked(docs), sequence), analyzer)

    @classmethod
    def _build(cls, docs: DataFrame, analyzer: Analyzer) -> SearchIndex:
        each = docs.select("doc_id", F.explode("fields").alias("field", "text")).where("text is not null")
        forward = each.select("field", "doc_id", analyzer.terms(F.col("text")).alias("terms")).withColumn("doc_len", F.size("terms"))
        return cls._of(analyzer, docs.select("doc_id"), forward, forward.select("field").distinct())

    @classmethod
    def _of(cls, analyzer: Analyzer, documents: DataFrame, forward: DataFrame, fields: DataFrame) -> SearchIndex:
        # a document's postings come from its own row, so nothing is exchanged
        postings = forward.select("field", "doc_id", "terms", "doc_len").mapInArrow(_postings, _POSTINGS)
        return cls(analyzer, documents, forward, postings, dictionary(postings), fields)

    def save(self, path: str | None = None) -> SearchIndex:
        """The index as written tables, by field: the dictionary ordered by term, and postings in runs of that order, for pruning."""
        spark = self.documents.sparkSession
        path = path or new_folder(spark, "index")
        self.documents.write.parquet(f"{path}/documents")
        self.forward.sortWithinPartitions("field", "doc_id").write.partitionBy("field").parquet(f"{path}/forward")
        forward = _read(spark, path, "forward", self.forward)
        kept = SearchIndex._of(self.analyzer, spark.read.parquet(f"{path}/documents"), forward, self.fields)
        with _side_by_side(spark):  # a sort by field would mix the sorted runs
            kept.postings.write.partitionBy("field").parquet(f"{path}/postings")
        postings = _read(spark, path, "postings", self.postings)
        dictionary(postings).sortWithinPartitions("field", "term").write.partitionBy("field").parquet(f"{path}/terms")
        self.fields.distinct().write.parquet(f"{path}/fields")
        return SearchIndex.load(spark, path, self.analyzer)

    @classmethod
    def load(cls, spark: SparkSession, path: str, analyzer: Analyzer | None = None) -> SearchIndex:
        schemas = {
            "documents": "doc_id string",
            "forward": "doc_id string, terms array<string>, doc_len int, field string",
            "postings": "term string, doc_id string, tf int, positions array<int>, doc_len int, field string",
            "terms": "term string, df bigint, ttf bigint, n_chars int, field string",
            "fields": "field string",
        }
        return cls(analyzer or STANDARD, *[spark.read.schema(schemas[t]).parquet(f"{path}/{t}") for t in TABLES])

    def add(self, docs: DataFrame, sequence: str | None = None) -> SearchIndex:
        """With `docs` added; a document that was there under the same id is replaced as a whole."""
        docs = _latest(_checked(docs), sequence)
        new, kept = SearchIndex._build(docs, self.analyzer), self.delete(docs.select("doc_id"))
        return replace(
            new,
            documents=kept.documents.union(new.documents),
            forward=kept.forward.unionByName(new.forward),
            postings=kept.postings.unionByName(new.postings),
            terms=dictionary(kept.postings.unionByName(new.postings)),
            fields=self.fields.union(new.fields).distinct(),
        )

    def delete(self, ids: DataFrame) -> SearchIndex:
        """Without the documents of the column doc_id; their fields stay listed."""
        gone = ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
        postings = self.postings.join(gone, "doc_id", "left_anti")
        return replace(self, documents=self.documents.join(gone, "doc_id", "left_anti"), forward=self.forward.join(gone, "doc_id", "left_anti"), postings=postings, terms=dictionary(postings))

    def present(self, ids: DataFrame) -> DataFrame:
        """(doc_id, present) of each id: whether deleting it would remove a document."""
        asked = ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
        here = self.documents.select("doc_id", F.lit(True).alias("present")).distinct()
        return asked.join(here, "doc_id", "left").select("doc_id", F.coalesce("present", F.lit(False)).alias("present"))

    def has(self, doc_id: str) -> bool:
        return not self.documents.where(F.col("doc_id") == doc_id).limit(1).isEmpty()

    def field_names(self) -> list[str]:
        return [r.field for r in self.fields.distinct().orderBy("field").collect()]

    def field_stats(self) -> DataFrame:
        """(field, n_docs, total_len, avg_len) of the fields that live documents have; a text without terms counts."""
        total = F.sum("doc_len").cast("bigint")
        return self.forward.groupBy("field").agg(F.count("*").alias("n_docs"), total.alias("total_len"), F.avg("doc_len").alias("avg_len"))

    @cached_property
    def stats(self) -> Stats:
        rows = self.field_stats().collect()  # one row a field
        return Stats(self.documents.count(), {r.field: float(r.avg_len) for r in rows})


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of rows of the forward table, in runs of about RUN_TERMS terms, each ordered by field, term and doc_id."""
    held, size = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            part = batch.slice(k, 1000)
            held.append(part)
            size += pc.sum(part["doc_len"]).as_py() or 0
            if size >= RUN_TERMS:
                yield from _run(held)
                held, size = [], 0
                pa.default_memory_pool().release_unused()  # the worker shares its memory with the JVM's
    if held:
        yield from _run(held)


def _run(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held)
    rows = rows.take(pc.sort_indices(rows.select(["field", "doc_id"]), sort_keys=[("field", "ascending"), ("doc_id", "ascending")])).combine_chunks()
    if not rows.num_rows:
        return
    field, doc_id, lists, doc_len = (rows[c].chunk(0) for c in ("field", "doc_id", "terms", "doc_len"))
    lengths = lists.value_lengths().to_numpy()
    terms = lists.flatten().dictionary_encode()
    by_term = pc.sort_indices(terms.dictionary)
    rank = np.empty(len(by_term), np.int64)
    rank[by_term.to_numpy()] = np.arange(len(by_term))
    names = field.to_numpy(zero_copy_only=False)
    nth = np.cumsum(np.append(0, names[1:] != names[:-1]))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    key = nth[doc] * len(by_term) + rank[terms.indices.to_numpy()]
    order = np.argsort(key, kind="stable")  # rows are in order, so documents of a term are
    key, doc, at = key[order], doc[order], at[order].astype(np.int32)
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))[: len(key)])
    ends = np.append(first, len(key))
    words = terms.dictionary.take(by_term)
    for k in range(0, len(first), RUN_ROWS):
        own = first[k : k + RUN_ROWS]
        here, edges = pa.array(doc[own]), ends[k : k + len(own) + 1]
        positions = pa.ListArray.from_arrays(pa.array((edges - edges[0]).astype(np.int32)), pa.array(at[edges[0] : edges[-1]]))
        tf = pa.array(np.diff(edges).astype(np.int32))
        yield pa.RecordBatch.from_arrays([field.take(here), words.take(pa.array(key[own] % len(by_term))), doc_id.take(here), tf, positions, doc_len.take(here)], ["field", "term", "doc_id", "tf", "positions", "doc_len"])


@contextmanager
def _side_by_side(spark: SparkSession) -> Iterator[None]:
    """Files of up to OPEN_FILES partitions are written at once, so that rows keep their order and needn't be sorted."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, OPEN_FILES)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def dictionary(postings: DataFrame) -> DataFrame:
    out = postings.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").cast("bigint").alias("ttf"))
    return out.withColumn("n_chars", F.char_length("term"))


def _read(spark: SparkSession, path: str, table: str, like: DataFrame) -> DataFrame:
    cols = [f for f in like.schema.fields if f.name != "field"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cols) + ", field string"
    return spark.read.schema(schema).parquet(f"{path}/{table}")


def _checked(docs: DataFrame) -> DataFrame:
    bad = F.col("doc_id").isNull() | (F.col("doc_id") == "") | F.col("fields").isNull()
    error = F.raise_error(F.lit(str(SearchError("add", "a document needs an id and fields")))).cast("string")
    return docs.withColumn("doc_id", F.when(bad, error).otherwise(F.col("doc_id")))


def _latest(docs: DataFrame, sequence: str | None) -> DataFrame:
    """One row of each doc_id.

    Rows of an id that recurs are told by `sequence` alone, without their texts; only of those that tie do texts count, and each
    partition sends one row of an id.  With up to BROADCAST_IDS such ids no text is exchanged but that.
    """
    counts = docs.groupBy("doc_id").count()
    again = counts.where("count > 1").select("doc_id")
    try:
        none = again.isEmpty()
    except SparkException:  # a row that isn't a document: the plan itself will say so
        none = True
    if none:
        return docs.select("doc_id", "fields")
    again = cut(again)
    few = again.count() <= BROADCAST_IDS
    rows = docs.join(F.broadcast(again) if few else again, "doc_id", "left_semi")
    if sequence:
        last = rows.groupBy("doc_id").agg(F.max(f"`{sequence}`").alias("_last"))  # null if all are: a null is before any other
        rows = rows.join(F.broadcast(last) if few else last, "doc_id").where(F.col(f"`{sequence}`").eqNullSafe(F.col("_last")))
    whole = F.to_json(F.array_sort(F.map_entries("fields")))
    last = cut(rows.groupBy("doc_id").agg(F.max_by("fields", whole).alias("fields")))
    if counts.where("count = 1").isEmpty():
        return last
    return docs.join(F.broadcast(again) if few else again, "doc_id", "left_anti").select("doc_id", "fields").union(last)
