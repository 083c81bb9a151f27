"""Document quality from a linear-chain conditional random field over lines.

Every line that isn't blank gets features of its characters and words, and those of the lines before and after
it.  The field labels lines good or bad.  Forward-backward marginals of the lines, weighted by length, are the document's quality.

Labels are known of documents only, so those of lines are latent.  The field is fitted by expectation maximisation
with the label of the document as evidence on its quality: the expected labels of
a document's lines are those of the field, all lines tilted alike as far as needed for an expected share of good lines, by length, of
at least GOOD_SHARE in a good document, and of two standard deviations below BAD_SHARE in a bad one: a document of one line passes its
label on, one of many lines may be bad with many good lines.  So a clean line may stay good in a bad document, and the
transitions are learned from the labels that lines come to have.

All sequences of a chunk move through the chain together, one line per step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import mapper
from ._text import Segments, Words, chunks, flat, mix, runs

TRAIN_DOCS = 4000  # labelled documents that the field is fitted to, at most
KEEP = 0.5  # least quality of a document that is kept
GOOD_SHARE, BAD_SHARE = 0.9, 0.5
PIECE = 512  # lines of a labelled document that the field is fitted to as one sequence; longer ones are cut into such pieces

_LOWER, _UPPER, _DIGIT, _POINT, _SHOUT, _SYMBOL, _BLANK = range(7)
_CLASS = np.full(256, _SYMBOL, np.uint8)
for _c, _set in ((_LOWER, range(97, 123)), (_LOWER, range(128, 256)), (_UPPER, range(65, 91)), (_DIGIT, range(48, 58)), (_POINT, b".,;:?'\"()-"), (_SHOUT, b"!"), (_BLANK, [*range(9, 14), *range(28, 33)])):
    _CLASS[list(_set)] = _c
_ENDS = np.zeros(256, bool)
_ENDS[list(b".?!:;\"')")] = True
OWN = 12


@dataclass(frozen=True)
class Field:
    """Weights: of the features for good over bad, of each transition [from, to], and of the first label."""

    emission: np.ndarray
    transition: np.ndarray


class LineFeatures:
    """The lines of some texts that aren't blank: row, length in bytes, own features and those of the neighbours."""

    def __init__(self, texts: pa.Array):
        data, off = flat(texts)
        kind = _CLASS[data]
        if len(data) > 1:  # capitals of two bytes: U+00C0 to U+00DE
            capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        kind[1:][capital] = _UPPER
        kind[:-1][capital] = _UPPER
        breaks = np.flatnonzero(data == 10)
        begin = np.union1d(off[:-1][np.diff(off) > 0], breaks + 1)
        begin = begin[begin < len(data)]
        end = np.append(begin[1:], len(data))
        ink = np.concatenate([[0], np.cumsum(kind != _BLANK, dtype=np.int64)])
        full = ink[end] > ink[begin]
        self.begin = begin = begin[full]
        self.doc = np.searchsorted(off, begin, "right") - 1
        self.bound = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        n = len(begin)
        if not n:
            self.size, self.own, self.all = np.zeros(0, np.int64), np.zeros((0, OWN), np.float32), np.zeros((0, 3 * OWN + 3), np.float32)
            return
        count = [np.add.reduceat(kind == k, begin, dtype=np.int64) for k in range(7)]
        self.size = size = sum(count[:6])
        last = np.maximum.reduceat(np.where(kind != _BLANK, np.arange(len(data)), 0), begin)
        line = self.doc + np.searchsorted(breaks, begin)  # numbered over all texts, blank lines and all
        words = Words(texts)
        of_word = np.searchsorted(line, words.doc + np.searchsorted(np.flatnonzero(words.data == 10), words.start))
        n_words = np.bincount(of_word, minlength=n)[:n]
        again = np.zeros(len(words), bool)
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (of_word[1:] == of_word[:-1])
        key = (of_word.astype(np.uint64) << np.uint64(40)) | (words.hash >> np.uint64(24))
        key.sort()
        distinct = np.bincount((key[runs(key)[0]] >> np.uint64(40)).astype(np.int64), minlength=n)[:n]
        first = np.searchsorted(of_word, np.arange(n + 1))
        text = mix(Segments(words.hash)(first[:-1], first[1:]) ^ mix(self.doc.astype(np.uint64)))
        order = np.argsort(text, kind="stable")
        start, length = runs(text[order])
        copies = np.empty(n, bool)
        copies[order] = np.repeat(length > 1, length)
        some, w = np.maximum(size, 1), np.maximum(n_words, 1)
        self.own = np.stack(
            [
                np.log1p(size) / 8,
                count[_UPPER] / np.maximum(count[_UPPER] + count[_LOWER], 1),
                count[_DIGIT] / some,
                np.minimum(count[_SYMBOL] / some * 5, 1),
                np.minimum(count[_SHOUT] / some * 10, 1),
                np.minimum(count[_POINT] / some * 5, 1),
                np.bincount(of_word, weights=again, minlength=n)[:n] / w,
                (n_words - distinct) / w,
                np.minimum(size / w / 20, 1),
                _ENDS[data[last]],
                copies & (n_words > 0),
                n_words == 0,
            ],
            axis=1,
        ).astype(np.float32)
        after = np.zeros(n, bool)
        after[:-1] = self.doc[:-1] == self.doc[1:]
        before = np.concatenate([[False], after[:-1]])
        prev = np.where(before[:, None], np.roll(self.own, 1, axis=0), 0)
        next_ = np.where(after[:, None], np.roll(self.own, -1, axis=0), 0)
        flags = np.stack([np.ones(n), before, after], axis=1)
        self.all = np.concatenate([self.own, prev, next_, flags], axis=1).astype(np.float32)


def forward_backward(score: np.ndarray, bound: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(good) of each line, expected transitions [from, to], log of the partition function) of sequences of lines.

    score: of good over bad.  Sequence i has the lines bound[i] .. bound[i + 1] - 1.
    """
    length = np.diff(bound)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    at, length = bound[:-1][order], length[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), "left")  # sequences with more than t lines
    e = np.stack([np.zeros(len(score)), np.asarray(score, np.float64)], axis=1)
    top = e.max(axis=1)
    e = np.exp(e - top[:, None])
    m = np.exp(transition)
    alpha, scale = np.empty((len(score), 2)), np.ones(len(score))
    for t in range(steps):
        i = at[: active[t]] + t
        a = e[i] * 0.5 if t == 0 else (alpha[i - 1] @ m) * e[i]
        s = a.sum(axis=1)
        alpha[i], scale[i] = a / s[:, None], s
    beta = np.ones((len(score), 2))
    pairs = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        i = at[: active[t + 1]] + t
        ahead = e[i + 1] * beta[i + 1] / scale[i + 1][:, None]
        beta[i] = ahead @ m.T
        pairs += m * (alpha[i].T @ ahead)
    p = alpha * beta
    return p[:, 1] / np.maximum(p.sum(axis=1), 1e-300), pairs, float(np.log(scale).sum() + top.sum())


def expected_labels(score: np.ndarray, bound: np.ndarray, transition: np.ndarray, weight: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(good) of each line, expected transitions), the scores of each sequence tilted just so far that its label holds.

    weight: of each line, adding up to 1 in a sequence; good: the label of each sequence.
    """
    length = np.diff(bound)
    of = np.repeat(np.arange(len(length)), length)
    sign = np.where(good, 1.0, -1.0)
    low, high = np.zeros(len(length)), np.full(len(length), 12.0)
    tilt = np.zeros(len(length))
    for _ in range(8):
        p = forward_backward(score + (sign * tilt)[of], bound, transition)[0]
        share = np.bincount(of, weights=weight * p, minlength=len(length))
        spread = np.sqrt(np.bincount(of, weights=weight**2 * p * (1 - p), minlength=len(length)))
        holds = np.where(good, share >= GOOD_SHARE, share + 2 * spread <= BAD_SHARE)
        high, low = np.where(holds, tilt, high), np.where(holds, low, tilt)
        tilt = np.where(holds & (tilt == 0), 0.0, (low + high) / 2)
    return forward_backward(score + (sign * np.where(high == 0, 0.0, high))[of], bound, transition)[:2]


def fit(features: np.ndarray, bound: np.ndarray, size: np.ndarray, good: np.ndarray, rounds: int = 20, steps: int = 5, l2: float = 1e-3) -> Field:
    """Expectation maximisation: rounds of expected labels, each with some steps of Adam towards their likelihood.

    size: of each line; good: 0 or 1 for each sequence.
    """
    length = np.diff(bound)
    n, of = len(features), np.repeat(np.arange(len(length)), length)
    weight = size / np.maximum(np.bincount(of, weights=size, minlength=len(length)), 1)[of]
    theta = np.zeros(features.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds * steps + 1):
        w, tr = theta[:-4], theta[-4:].reshape(2, 2)
        score = features @ w
        if step % steps == 1:
            labels, seen = expected_labels(score, bound, tr, weight, good > 0)
        p, pairs, _ = forward_backward(score, bound, tr)
        g = np.concatenate([features.T @ (labels - p), (seen - pairs).ravel()]) / n - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(theta[:-4].copy(), theta[-4:].reshape(2, 2).copy())


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Field | None:
    """The field, fitted to at most `train_docs` labelled documents, those of the least hashes of doc_id.

    A doc_id with several labels has the lowest.  None if the sample lacks good or bad documents with lines.
    """
    sample = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_docs)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b in chunks(batch.column(1)):
            lines = LineFeatures(batch.column(1)[a:b])
            wide = np.concatenate([lines.all, lines.size[:, None].astype(np.float32)], axis=1)
            packed = [wide[lines.bound[i] : lines.bound[i + 1]].tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array(packed, pa.binary())], names=["doc_id", "quality", "lines"])

    # the sample is bounded by train_docs, so that it may be broadcast at any size of the tables
    some = rows.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality").mapInArrow(mapper(of), "doc_id bigint, quality int, lines binary").collect()
    some.sort(key=lambda r: (r.doc_id, bytes(r.lines)))
    width = 3 * OWN + 4
    pieces, good = [], []
    for r in some:
        x = np.frombuffer(r.lines, np.float32).reshape(-1, width)
        for at in range(0, len(x), PIECE):
            pieces.append(x[at : at + PIECE])
            good.append(r.quality)
    if len(set(good)) < 2:
        return None
    every = np.concatenate(pieces)
    return fit(every[:, :-1], np.concatenate([[0], np.cumsum([len(x) for x in pieces])]), every[:, -1].astype(np.float64), np.array(good, np.int64))


def scored(docs: DataFrame, field: Field | None) -> DataFrame:
    """All rows and columns of `docs`, with quality, n_lines, n_bad and line_good: P(good) of each line that isn't blank.

    Without a field every line is good.  A text without lines (null, empty or blank) has quality 0.0 and no lines.
    Columns of `docs` of these four names are replaced.
    """
    made = ["quality", "n_lines", "n_bad", "line_good"]
    keep = [c for c in docs.columns if c not in made]

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(batch.num_columns - 1)
        for a, b in chunks(texts):
            lines = LineFeatures(texts[a:b])
            good = np.ones(len(lines.size)) if field is None else forward_backward(lines.all @ field.emission, lines.bound, field.transition)[0]
            n = np.diff(lines.bound)
            weight = np.bincount(lines.doc, weights=lines.size, minlength=b - a)
            quality = np.bincount(lines.doc, weights=lines.size * good, minlength=b - a) / np.maximum(weight, 1)
            bad = np.bincount(lines.doc, weights=good < 0.5, minlength=b - a)
            lists = pa.ListArray.from_arrays(pa.array(lines.bound.astype(np.int32)), pa.array(good.astype(np.float32)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i)[a:b] for i in range(len(keep))), pa.array(quality), pa.array(n.astype(np.int32)), pa.array(bad.astype(np.int32)), lists], names=[*keep, *made]
            )

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text_to_score"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(mapper(of), f"{schema}, quality double, n_lines int, n_bad int, line_good array<float>")


def good_documents(docs: DataFrame, labels: DataFrame, keep: float = KEEP, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of scored() whose quality is at least `keep`; the others, texts without lines among them, are rejected.

    Labels of documents that aren't there, null labels and labels other than 0 and 1 are passed over; with none
    left, or none of one kind, every text that has lines is kept.  Repeated rows are judged alike.  doc_id is an integer, or a string
    of one, in documents and labels; any other string is an error of the cast.
    """
    return scored(docs, train(docs, labels, train_docs)).where(_good(keep))


def _good(keep: float) -> Column:
    return (F.col("n_lines") > 0) & (F.col("quality") >= keep)


def without_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns as they were, whatever their names."""
    plain = docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"c{i}") for i, c in enumerate(docs.columns)])
    kept = good_documents(plain, labels)
    return kept.select(*[F.col(p).alias(c) for p, c in zip(plain.columns, docs.columns, strict=True)])


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kept, quality, n_lines, n_bad, line_good) of every document of the table; kept tells whether it is good enough."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    every = scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return every.select("doc_id", _good(KEEP).alias("kept"), "quality", "n_lines", "n_bad", "line_good")
