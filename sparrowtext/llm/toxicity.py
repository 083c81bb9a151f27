"""Toxicity by weak supervision.

1. Lexicons: fixed lists of insults, and word beginnings induced from labelled documents, a bounded sample of each language.  What
   evidence a beginning needs follows from the number of labels that its language has.
2. Voters: each lexicon, and patterns over all their hits (density, variety, repetition, shouting), vote toxic, clean or
   neither on every document.
3. Label model: the counts of all vote vectors over the whole corpus are explained by a hidden class.  Expectation
   maximisation, with a weak prior that voters are right more often than not, fits, for each voter, its distribution given the class and one other voter; who depends on whom is the spanning tree of greatest
   mutual information given the class.  So accuracies and correlations are estimated without labels.
4. A linear classifier of hashed words and votes is fitted to the posterior labels of a bounded sample and
   scores every document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, lgamma

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, mapper
from ._text import _BYTE, Segments, Words, chunks, flat, lowered, member, mix, runs
from .jaccard import verified_sets

INDUCE_DOCS = 2000  # labelled documents of each language and label from which word beginnings are induced, at most
TRAIN_DOCS = 4000  # documents of either posterior label that the classifier is fitted to, at most
THRESHOLD = 0.5
DIMS = 1 << 16
BEGINNINGS = (4, 5)  # characters
CHANCE = 0.05  # beginnings of a language that may be taken by chance, in expectation
COPY = 0.4  # similarity of word pairs, as estimated, from which labelled documents are one piece of evidence
BANDS, BAND = 32, 3  # of least hashes, for that estimate
RATE = 0.004  # share of a document's words from which a lexicon votes toxic

LEXICONS = (
    ("idiot", "moron", "imbecile", "fool", "dumbass", "loser", "clown", "idiota", "imbécile", "dummkopf"),
    ("scum", "trash", "vermin", "garbage", "bastard", "asshole", "bitch", "abschaum", "ordure", "basura"),
    ("stupid", "pathetic", "worthless", "disgusting", "useless", "despicable", "dumb", "erbärmlich", "minable", "patético"),
)
INDUCED = 3  # lexicons that the induced beginnings are dealt to
# how voters of either class vote, before any is seen, in rows of clean and toxic; worth 0.5 % of the documents
PRIOR = np.array([[0.9, 0.05, 0.05], [0.25, 0.5, 0.25]])
VOTERS = len(LEXICONS) + INDUCED + 4


def word_keys(words: Words) -> list[np.ndarray]:
    """Hashes of every word and of its beginnings (0 where the word is shorter); a beginning never equals a word."""
    out = [words.hash]
    lead = np.flatnonzero((words.data & 0xC0) != 0x80)
    first, seg = np.searchsorted(lead, words.start), Segments(_BYTE[words.data])
    lead = np.append(lead, len(words.data))
    for k in BEGINNINGS:
        at = np.minimum(first + k, len(lead) - 1)
        end = lead[at]
        fits = (first + k < len(lead)) & (end <= words.end)
        end = np.where(fits, end, words.start)
        out.append(np.where(fits, mix(seg(words.start, end) + (end - words.start).astype(np.uint64)) ^ np.uint64(k), np.uint64(0)))
    return out


@dataclass(frozen=True)
class Terms:
    """Sorted hashes of all terms and the lexicon of each."""

    key: np.ndarray
    lexicon: np.ndarray


def terms_of(induced: list[str]) -> Terms:
    key, lexicon = [], []
    for i, some in enumerate(LEXICONS):
        key.append(Words(pa.array(some)).hash)
        lexicon.append(np.full(len(some), i))
    for i, term in enumerate(induced):
        key.append((Words(pa.array([term])).hash[:1]) ^ np.uint64(len(term)))
        lexicon.append(np.full(len(key[-1]), len(LEXICONS) + i % INDUCED))
    k, where = np.unique(np.concatenate(key), return_index=True)
    return Terms(k, np.concatenate(lexicon)[where])


def vote(texts: pa.Array, terms: Terms) -> tuple[np.ndarray, Words, list[np.ndarray]]:
    """votes[i, j]: 0 clean, 1 toxic, 2 neither, of voter j on text i; the words and their keys."""
    n = len(texts)
    words = Words(texts)
    keys = word_keys(words)
    hit = np.full(len(words), -1)
    for key in keys:
        at = member(key, terms.key)
        hit = np.where(hit < 0, at, hit)
    total = np.diff(words.bound)
    where = np.flatnonzero(hit >= 0)
    doc, term = words.doc[where], hit[where]
    n_lex = len(LEXICONS) + INDUCED
    by = np.bincount(doc * n_lex + terms.lexicon[term], minlength=n * n_lex).reshape(n, n_lex)
    rate = by / np.maximum(total, 1)[:, None]
    votes = np.full((n, VOTERS), 2)
    votes[:, :n_lex] = np.where(by == 0, 0, np.where(rate >= RATE, 1, 2))
    hits = by.sum(axis=1)
    density = hits / np.maximum(total, 1)
    pair = np.unique(doc * (len(terms.key) + 1) + term)
    variety = np.bincount(pair // (len(terms.key) + 1), minlength=n)
    votes[:, n_lex] = np.where(hits == 0, 0, np.where(density >= 2 * RATE, 1, 2))
    votes[:, n_lex + 1] = np.where(variety == 0, 0, np.where(variety >= 2, 1, 2))
    votes[:, n_lex + 2] = np.where(hits == 0, 0, np.where(hits >= 3, 1, 2))
    data, off = flat(texts)
    capital = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    small = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    up, low = capital[off[1:]] - capital[off[:-1]], small[off[1:]] - small[off[:-1]]
    votes[:, n_lex + 3] = np.where(up > low, 1, 2)
    return votes, words, keys


def pattern_of(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(votes.shape[1]))


def votes_of(pattern: np.ndarray, voters: int) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(voters) % 3


@dataclass
class LabelModel:
    """prior: of toxic.  parent[j]: the voter on which j depends, -1 for none.  table[j][class, vote of the parent, vote]."""

    prior: float
    parent: list[int]
    table: list[np.ndarray]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        score = np.log(np.array([1 - self.prior, self.prior]))[None].repeat(len(votes), 0)
        for j, p in enumerate(self.parent):
            above = votes[:, p] if p >= 0 else np.zeros(len(votes), np.int64)
            score += np.log(self.table[j][:, above, votes[:, j]]).T
        score -= score.max(axis=1, keepdims=True)
        e = np.exp(score)
        return e[:, 1] / e.sum(axis=1)

    def accuracy(self, votes: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Of each voter: the share of its votes for a class that are right, in expectation."""
        q = self.posterior(votes)[:, None]
        right = np.where(votes == 1, q, 1 - q) * (votes < 2) * count[:, None]
        return right.sum(axis=0) / np.maximum((count[:, None] * (votes < 2)).sum(axis=0), 1)


def _tree(votes: np.ndarray, weight: np.ndarray) -> list[int]:
    """Parents in the spanning tree of greatest mutual information given the class; weight[pattern, class]."""
    m = votes.shape[1]
    info = np.zeros((m, m))
    for i in range(m):
        for j in range(i):
            for c in (0, 1):
                joint = np.zeros((3, 3)) + 1e-9
                np.add.at(joint, (votes[:, i], votes[:, j]), weight[:, c])
                p = joint / weight.sum()
                own = p / p.sum()
                info[i, j] += (p * np.log(own / (own.sum(1, keepdims=True) * own.sum(0, keepdims=True)))).sum()
    info += info.T
    parent, inside = [-1] * m, {0}
    while len(inside) < m:
        _, a, b = max((info[a, b], -a, -b) for a in inside for b in range(m) if b not in inside)
        parent[-b] = -a
        inside.add(-b)
    return parent


def fit_label_model(votes: np.ndarray, count: np.ndarray, steps: int = 40) -> LabelModel:
    """Expectation maximisation over distinct vote vectors; it starts from the balance of the votes."""
    toxic, clean = (votes == 1).sum(axis=1), (votes == 0).sum(axis=1)
    q = np.where(toxic >= 2, 0.95, np.where((toxic == 1) & (clean < votes.shape[1] - 2), 0.3, 0.02))
    parent: list[int] = []
    for step in range(steps):
        weight = np.stack([1 - q, q], axis=1) * count[:, None]
        if step in (0, 5, 15):
            parent = _tree(votes, weight)
        table = []
        for j, p in enumerate(parent):
            above = votes[:, p] if p >= 0 else np.zeros(len(votes), np.int64)
            t = PRIOR[:, None, :].repeat(3, axis=1) * max(5.0, 0.005 * count.sum())
            for c in (0, 1):
                np.add.at(t[c], (above, votes[:, j]), weight[:, c])
            table.append(t / t.sum(axis=2, keepdims=True))
        model = LabelModel(float(np.clip(weight[:, 1].sum() / weight.sum(), 1e-4, 0.5)), parent, table)
        q = model.posterior(votes)
    return model


def _hashed(words: Words, keys: list[np.ndarray], votes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value): words and beginnings by the root of their share, and the votes."""
    rows, feats, values = [], [], []
    total = np.maximum(np.diff(words.bound), 1)
    for key in keys:
        doc = words.doc[key != 0]
        pair = (doc.astype(np.uint64) << np.uint64(16)) | (key[key != 0] % np.uint64(DIMS))
        pair.sort()
        start, n = runs(pair)
        row = (pair[start] >> np.uint64(16)).astype(np.int64)
        rows.append(row)
        feats.append((pair[start] & np.uint64(DIMS - 1)).astype(np.int64))
        values.append(np.sqrt(n / total[row]))
    k, m = votes.shape
    rows.append(np.repeat(np.arange(k), m))
    feats.append(DIMS + (votes + 3 * np.arange(m)).ravel())
    values.append(np.full(k * m, 0.5))
    return np.concatenate(rows), np.concatenate(feats), np.concatenate(values)


def fit_linear(row: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray, steps: int = 80, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, either side weighted alike, by Adam."""
    n = len(label)
    side = np.where(label > 0.5, 0.5 / max((label > 0.5).sum(), 1), 0.5 / max((label <= 0.5).sum(), 1))
    theta = np.zeros(DIMS + 3 * VOTERS + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=value * theta[feature], minlength=n) + theta[-1]
        g = (label - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) * side
        grad = np.append(np.bincount(feature, weights=value * g[row], minlength=len(theta) - 1), g.sum()) - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return theta[:-1], float(theta[-1])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")


def chance(t: int, c: int, nt: int, nc: int) -> float:
    """How likely t or more of t + c documents, drawn from nt toxic and nc other ones, are toxic."""

    def log_choose(n: int, k: int) -> float:
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    n = t + c
    return min(1.0, sum(exp(log_choose(nt, k) + log_choose(nc, n - k) - log_choose(nt + nc, n)) for k in range(max(t, n - nc), min(nt, n) + 1)))


def level_of(margins: dict[int, int], nt: int, nc: int) -> float:
    """The chance up to which a beginning is taken; margins: how many beginnings count in n documents, for each n.

    Beginnings of so few documents that not even all of them being toxic would do aren't counted as tried.
    """
    least = sorted((chance(min(n, nt), n - min(n, nt), nt, nc), k) for n, k in margins.items())
    tried = 1
    while sum(k for p, k in least if p <= CHANCE / tried) > tried:
        tried = max(tried + 1, int(tried * 1.02))
    return CHANCE / tried


def least_hashes(texts: pa.Array) -> np.ndarray:
    """[i, k]: the least of the k-th hashes of the word pairs of text i; those of two texts agree in a share that estimates their similarity."""
    token, bound = verified_sets(texts, 2)
    out = np.full((len(texts), BANDS * BAND), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(bound))
    if len(some):
        for k in range(0, BANDS * BAND, 2):
            h = mix(token ^ mix(np.array([k + 1], np.uint64)))
            for i, half in enumerate((h >> np.uint64(32), h & np.uint64(0xFFFFFFFF))):
                out[some, k + i] = np.minimum.reduceat(half, bound[:-1][some])
    return out


def part_of(sketch: np.ndarray) -> np.ndarray:
    """For each row of least hashes: the first row of its part of near copies.  Rows that agree in a band are compared with the first of them."""
    low = np.arange(len(sketch))
    u, v = [], []
    for b in range(0, sketch.shape[1], BAND):
        same = np.unique(sketch[:, b : b + BAND], axis=0, return_inverse=True)[1].ravel()
        first = np.full(len(sketch), len(sketch))
        np.minimum.at(first, same, low)
        other = np.flatnonzero(first[same] < low)
        near = (sketch[other] == sketch[first[same[other]]]).mean(axis=1) >= COPY
        u.append(first[same[other[near]]])
        v.append(other[near])
    u, v = np.concatenate(u), np.concatenate(v)
    while True:
        least = np.minimum(low[u], low[v])
        new = low.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def induce(docs: DataFrame, labels: DataFrame, induce_docs: int = INDUCE_DOCS) -> list[str]:
    """Word beginnings that mark toxic documents of some language, best first.

    They come from at most `induce_docs` labelled documents of each language and label, those of the least hashes of doc_id.  Of
    near copies with one label, only the earliest document counts: all the words of a copied text would pass for marks of it.  A
    beginning counts in a document if it makes up a share RATE of the words; it is taken if it counts in toxic documents 4 times as
    often, by share, as in those that are not, and that would be chance in fewer than CHANCE of all beginnings of
    the language that could pass: with hundreds of labels a tenth of the toxic documents is enough, with five nearly all must have it, and with three
    none is taken, so that the fixed lists alone vote in such a language.
    """
    spark = docs.sparkSession
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    language = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), language.alias("lang")).where("text is not null")
    # only ids and languages are joined and ranked; partitions keep their first ones before they are exchanged
    order = F.expr("row_number() over (partition by lang, toxic order by xxhash64(doc_id), doc_id)")
    sample = rows.select("doc_id", "lang").distinct().join(known, "doc_id").withColumn("_n", order).where(F.col("_n") <= induce_docs).select("doc_id", "lang", "toxic")

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        low = lowered(batch.column(1))
        for a, b in chunks(low):
            words = Words(low[a:b], lower=False)
            raw, off = words.data.tobytes(), words.bound
            terms: list[list[str]] = []
            for i in range(b - a):
                n: Counter[str] = Counter()
                for s, e in zip(words.start[off[i] : off[i + 1]].tolist(), words.end[off[i] : off[i + 1]].tolist(), strict=True):
                    w = raw[s:e].decode("utf-8", "replace")
                    for k in BEGINNINGS:
                        if len(w) >= k:
                            n[w[:k]] += 1
                least = RATE * (off[i + 1] - off[i])
                terms.append(["", *(w for w, c in n.items() if c >= least)])  # "": the document itself
            sketch = [x.tobytes() for x in least_hashes(low[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *(batch.column(c)[a:b] for c in (2, 3)), pa.array(sketch, pa.binary()), pa.array(terms, pa.list_(pa.string()))], names=["doc_id", "lang", "toxic", "sketch", "terms"])

    drawn = rows.join(sample, ["doc_id", "lang"]).select("doc_id", "text", "lang", "toxic")
    drawn = cut(drawn.mapInArrow(mapper(of), "doc_id bigint, lang string, toxic int, sketch binary, terms array<string>").dropDuplicates(["doc_id", "lang", "toxic", "sketch"]))
    marks = drawn.select("doc_id", "lang", "toxic", F.xxhash64("sketch").alias("mark"), "sketch").orderBy("doc_id", "lang", "mark").toArrow()  # of a bounded sample
    sketch = np.frombuffer(b"".join(marks["sketch"].to_pylist()), np.uint32).reshape(marks.num_rows, BANDS * BAND)
    one = np.unique(np.array([*zip(part_of(sketch).tolist(), pc.rank(marks["lang"], tiebreaker="min").to_pylist(), marks["toxic"].to_pylist(), strict=True)], np.int64).reshape(-1, 3), axis=0, return_index=True)[1]
    kept = spark.createDataFrame(marks.select(["doc_id", "lang", "mark"]).take(pa.array(one)))
    seen = drawn.withColumn("mark", F.xxhash64("sketch")).join(F.broadcast(kept), ["doc_id", "lang", "mark"]).select("lang", "toxic", F.explode("terms").alias("term"))
    counts = cut(seen.groupBy("lang", "term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")))
    totals = counts.where("term = ''").select("lang", F.col("t").alias("nt"), F.col("c").alias("nc"))
    margins: dict[str, dict[int, int]] = {}
    for r in counts.where("term <> ''").groupBy("lang", (F.col("t") + F.col("c")).alias("n")).count().collect():  # of a bounded sample, as below
        margins.setdefault(r.lang, {})[r.n] = r["count"]
    total = {r.lang: (r.nt, r.nc) for r in totals.where("nt > 0 and nc > 0").collect()}
    level = {lang: level_of(margins.get(lang, {}), *both) for lang, both in total.items()}
    likely = counts.where("term <> '' and t >= 2").join(totals, "lang").where("nt > 0 and nc > 0 and t / nt >= 4 * c / nc")
    best: dict[str, float] = {}
    for r in likely.collect():
        p = chance(r.t, r.c, r.nt, r.nc)
        if p <= level[r.lang]:
            best[r.term] = min(p, best.get(r.term, 1.0))
    return sorted(best, key=lambda w: (best[w], w))


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, induce_docs: int = INDUCE_DOCS, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, probability, posterior) of the documents that the classifier calls toxic.

    probability: of the classifier, at least `threshold`; posterior: of the label model, for the votes on the document.
    Rows without doc_id or text are passed over; an empty text gets the votes of no hits.  A repeated row is
    judged again, alike; long texts are judged whole.  doc_id is an integer, or a string of one; any other string is an error of the cast.
    Without labels the fixed lexicons alone vote; if no document, or every one, is called
    toxic by the label model, its posterior is the probability.  Columns beyond doc_id, text and lang are not read.
    """
    spark = docs.sparkSession
    terms = terms_of(induce(docs, labels, induce_docs))

    def ballots(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b in chunks(batch.column(1)):
            votes = vote(batch.column(1)[a:b], terms)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(pattern_of(votes))], names=["doc_id", "pattern"])

    texts = _texts(docs)
    cast = cut(texts.mapInArrow(mapper(ballots), "doc_id bigint, pattern bigint"))
    counted = cast.groupBy("pattern").count().collect()  # at most 3 ** VOTERS rows, whatever the corpus
    pattern, count = np.array([r["pattern"] for r in counted], np.int64), np.array([r["count"] for r in counted], np.float64)
    if not len(pattern):
        return spark.createDataFrame([], "doc_id bigint, probability double, posterior double")
    order = np.argsort(pattern)
    pattern, count = pattern[order], count[order]
    model = fit_label_model(votes_of(pattern, VOTERS), count)
    posterior = model.posterior(votes_of(pattern, VOTERS))

    known = spark.createDataFrame(list(zip(pattern.tolist(), posterior.tolist(), strict=True)), "pattern bigint, posterior double")
    labelled = cast.join(F.broadcast(known), "pattern").select("doc_id", "posterior")
    sides = [labelled.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs) for c in ("posterior > 0.5", "posterior <= 0.5")]
    sample = cut(sides[0].union(sides[1]).dropDuplicates(["doc_id"]))

    def features(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b in chunks(batch.column(1)):
            votes, words, keys = vote(batch.column(1)[a:b], terms)
            row, feature, value = _hashed(words, keys, votes)
            order = np.argsort(row, kind="stable")
            edge = np.searchsorted(row[order], np.arange(b - a + 1))
            f, v = feature[order].astype(np.int32), value[order].astype(np.float32)
            packed = [[x[edge[i] : edge[i + 1]].tobytes() for i in range(b - a)] for x in (f, v)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], *(pa.array(x, pa.binary()) for x in packed)], names=["doc_id", "posterior", "f", "v"])

    got = texts.join(F.broadcast(sample), "doc_id").mapInArrow(mapper(features), "doc_id bigint, posterior double, f binary, v binary").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.f)))
    f = [np.frombuffer(r.f, np.int32) for r in got]
    row = np.repeat(np.arange(len(f)), [len(x) for x in f])
    label = np.array([r.posterior for r in got])
    linear = None
    if (label > 0.5).any() and (label <= 0.5).any():
        linear = fit_linear(row, np.concatenate(f), np.concatenate([np.frombuffer(r.v, np.float32) for r in got]).astype(np.float64), label)
    shared = spark.sparkContext.broadcast((terms, linear, pattern, posterior))

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        terms, linear, pattern, posterior = shared.value
        for a, b in chunks(batch.column(1)):
            votes, words, keys = vote(batch.column(1)[a:b], terms)
            own = posterior[np.searchsorted(pattern, pattern_of(votes))]
            p = own
            if linear is not None:
                row, feature, value = _hashed(words, keys, votes)
                z = np.bincount(row, weights=value * linear[0][feature], minlength=b - a) + linear[1]
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            bad = np.flatnonzero(p >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].take(pa.array(bad)), pa.array(p[bad]), pa.array(own[bad])], names=["doc_id", "probability", "posterior"])

    return texts.mapInArrow(mapper(score), "doc_id bigint, probability double, posterior double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
