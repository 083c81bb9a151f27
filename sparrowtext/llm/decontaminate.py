"""Benchmark decontamination: a prefix-filtered containment join of benchmark items with document windows.

1. One scan of the documents keeps every occurrence (document, position) of a benchmark n-gram.
2. Those occurrences give each benchmark n-gram its document frequency over the whole corpus, and
   that orders the n-grams of an item by rarity.
3. Of m n-grams an item needs ceil(t * m) in one window, so every match holds one of its
   m - ceil(t * m) + 1 rarest: only these prefix n-grams open candidates.
4. An occurrence at position p of an n-gram at position q of an item can only lie in item-sized windows
   that hold p (positional bound); a candidate whose surroundings hold too few occurrences of the item's n-grams
   is dropped (length bound), and the others are slid over exactly.

An item of fewer than n words is one shorter n-gram, of all its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Filter, bloom, cut, mapper
from ._text import Words, chunks, member, mix, ngrams

N = 4
CONTAINMENT = 0.7
BROADCAST_GRAMS = 4_000_000  # 32 MB; n-grams of a larger benchmark are sifted by a filter of 8 MB and joined by a shuffle

RESULT = "doc_id bigint, item_id bigint, containment double, word_at bigint"


def _texts(rows: DataFrame, key: str) -> DataFrame:
    rows = rows.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))
    return rows.where(F.col(key).isNotNull() & F.col("text").isNotNull())


def _grams(words: Words, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """ngrams(), those of fewer words told apart from those of n."""
    at, h = ngrams(words, n)
    return at, h if n == least else mix(h ^ np.uint64(n))


def item_grams(items: DataFrame, n: int = N) -> DataFrame:
    """(item_id, gram, window, n_words): distinct n-grams of each item, the number of its n-gram positions, and of words in one."""

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0)
        for a, b in chunks(batch.column(1)):
            words = Words(batch.column(1)[a:b])
            size = np.diff(words.bound)
            for k in range(1, n + 1):
                at, h = _grams(words, k, n)
                doc = words.doc[at]
                own = np.ones(len(doc), bool) if k == n else size[doc] == k
                doc, h = doc[own], h[own]
                total = np.bincount(doc, minlength=b - a)
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                doc, h = doc[new], h[new]
                yield pa.RecordBatch.from_arrays(
                    [ids[a:b].take(pa.array(doc)), pa.array(h.view(np.int64)), pa.array(total[doc]), pa.array(np.full(len(doc), k, np.int32))], names=["item_id", "gram", "window", "n_words"]
                )

    return _texts(items, "item_id").mapInArrow(mapper(of), "item_id bigint, gram bigint, window bigint, n_words int").groupBy("item_id", "gram").agg(F.max("window").alias("window"), F.max("n_words").alias("n_words"))


def occurrences(docs: DataFrame, grams: np.ndarray | Filter, n: int = N, shorter: tuple[int, ...] = ()) -> DataFrame:
    """(doc_id, gram, at) of the n-grams of documents, and of those of `shorter` words, that are in a sorted table or pass a filter."""
    bits = np.zeros(1 << 22, bool)
    if isinstance(grams, np.ndarray):
        bits[(grams & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast((grams, bits))

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0)
        table, maybe = shared.value
        for a, b in chunks(batch.column(1)):
            words = Words(batch.column(1)[a:b])
            for k in (*shorter, n):
                at, h = _grams(words, k, n)
                if isinstance(table, np.ndarray):
                    hit = np.flatnonzero(maybe[(h & np.uint64(len(maybe) - 1)).astype(np.int64)])
                    hit = hit[member(h[hit], table) >= 0]
                else:
                    hit = np.flatnonzero(table.test(h))
                at, h = at[hit], h[hit]
                doc = words.doc[at]
                yield pa.RecordBatch.from_arrays([ids[a:b].take(pa.array(doc)), pa.array(h.view(np.int64)), pa.array(at - words.bound[doc])], names=["doc_id", "gram", "at"])

    return _texts(docs, "doc_id").mapInArrow(mapper(of), "doc_id bigint, gram bigint, at bigint")


def _best_window(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The fullest item-sized window of each candidate (document, item): its distinct n-grams, for all windows of all candidates at once."""
    doc, item, need, m, window = (batch.column(i).to_numpy() for i in range(5))
    hits = batch.column(5)
    flat_hits, size = hits.flatten(), hits.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    at, gram = (flat_hits.field(c).to_numpy(zero_copy_only=False) for c in ("at", "gram"))
    if not len(at):
        return
    k = len(at)
    of = np.repeat(np.arange(len(size)), size)
    base = of * (int(at.max()) + int(window.max()) + 2)  # candidates far apart, so that no window spans two
    key = base + at
    order = np.lexsort((at, gram, of))
    again = np.full(k, k)  # the next occurrence of the same n-gram in the candidate
    same = (gram[order][1:] == gram[order][:-1]) & (of[order][1:] == of[order][:-1])
    again[order[:-1][same]] = order[1:][same]
    # an occurrence counts in the windows that end at it, and on to its next one or to where it falls out
    out = np.minimum(again, np.searchsorted(key, key + window[of], "left"))
    step = np.ones(k + 1, np.int64)
    step[k] = 0
    np.subtract.at(step, out, 1)
    seen = np.cumsum(step)[:k]
    start = np.cumsum(size) - size
    best = np.maximum.reduceat(seen, start)
    right = np.minimum.reduceat(np.where(seen == best[of], np.arange(k), k), start)
    left = np.searchsorted(key, key[right] - window + 1, "left")
    good = best >= need
    yield pa.RecordBatch.from_arrays([pa.array(doc[good]), pa.array(item[good]), pa.array(best[good] / m[good]), pa.array(at[left[good]])], names=["doc_id", "item_id", "containment", "word_at"])


def contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, n: int = N, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """Every (doc_id, item_id) where one window of the document, of as many n-grams as the item has, holds at
    least `containment` of the item's distinct n-grams; with the best containment and the first word of that window.

    An item of fewer than n words is in a document that has its words, all of them, one after the other.  Documents or items with a
    null id or text or without words match nothing.  Ids are integers, or strings of such; any other string is an error of the cast.  Rows
    that share a doc_id count as one document with the occurrences of all.  Items with equal text each get their own rows.
    An item_id that recurs is one item with the n-grams of all its rows, as wide as its widest row.  Long texts are read whole.
    Columns beyond doc_id, item_id and text are ignored, whatever their names.  Empty tables give an empty result.
    """
    known = cut(item_grams(items, n))
    count, *some = known.agg(F.count("*"), *[F.max(F.col("n_words") == k) for k in range(1, n)]).first()
    shorter = tuple(k for k, there in enumerate(some, 1) if there)
    distinct = known.select("gram").distinct()
    if count <= broadcast_grams:
        table = np.sort(distinct.toArrow().column(0).to_numpy().view(np.uint64))
        found = occurrences(docs, table, n, shorter)
    else:
        found = occurrences(docs, bloom(distinct, "gram"), n, shorter).join(distinct, "gram", "left_semi").select("doc_id", "gram", "at")
    return matches(cut(found), known, containment)


def matches(found: DataFrame, known: DataFrame, containment: float) -> DataFrame:
    """The join proper, from the occurrences of benchmark n-grams."""
    rarity = found.groupBy("gram").agg(F.countDistinct("doc_id").alias("df"))
    size = known.groupBy("item_id").agg(F.count("*").alias("m"), F.max("window").alias("window"))
    need = F.ceil(F.round(F.lit(containment) * F.col("m"), 9)).cast("bigint")
    ordered = known.select("item_id", "gram").join(size, "item_id").join(rarity, "gram", "left").na.fill(0, ["df"]).withColumn("need", need)
    rank = F.expr("row_number() over (partition by item_id order by df, gram)")
    grams = cut(ordered.withColumn("rank", rank))
    opened = found.join(grams.where("rank <= m - need + 1 and df > 0").select("gram", "item_id", "window"), "gram").select("doc_id", "item_id", F.col("at").alias("open"), "window")
    # positional bound: a window that holds `open` lies within window - 1 places on either side; openings that
    # close to one another share a stretch, so that no occurrence is taken twice
    step = F.expr("open - lag(open) over (partition by doc_id, item_id order by open) >= 2 * window")
    part = F.expr("sum(if(far, 1, 0)) over (partition by doc_id, item_id order by open)")
    stretch = (
        opened.distinct()
        .withColumn("far", F.coalesce(step, F.lit(False)))
        .withColumn("part", part)
        .groupBy("doc_id", "item_id", "part")
        .agg((F.min("open") - F.max("window") + 1).alias("low"), (F.max("open") + F.max("window") - 1).alias("high"))
    )
    all_hits = found.join(grams.select("gram", "item_id", "need", "m", "window"), "gram")
    near = all_hits.join(stretch, ["doc_id", "item_id"]).where("at between low and high")
    groups = near.groupBy("doc_id", "item_id", "need", "m", "window").agg(F.array_sort(F.collect_set(F.struct("at", "gram"))).alias("hits"), F.countDistinct("gram").alias("k"))
    verified = groups.where("k >= need").select("doc_id", "item_id", "need", "m", "window", "hits")
    return verified.mapInArrow(mapper(_best_window), RESULT)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document of the table holds; see contaminated()."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, all columns kept, without those that hold a benchmark item.

    A row without doc_id or text stays; rows that share a doc_id go together.  An item of one word or two takes every document that has
    it: leave such items out of `items` if that isn't meant.
    """
    bad = contaminated(docs, items).select(F.col("doc_id").alias("bad")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # so that no name clashes
    kept = rows.join(bad, F.col("row.doc_id").cast("long") == F.col("bad"), "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
