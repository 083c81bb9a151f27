"""Line deduplication by a deletion-neighbourhood join.

A line is the sequence of its lower-cased words.  Two lines are copies if the sequences are equal, or if one edit turns
one into the other: a unit inserted, deleted or replaced.  The units of a line of NEAR words or more are its words; those of a
shorter line are its characters, with one space between words.  One edit is allowed in NEAR units, so a shorter line of fewer
characters has equal copies only, and lines of different units are no copies.

1. Every line is hashed.  Equal hashes meet in one partition, which keeps the earliest occurrence.
   Beside it, each line that may have near copies sends the hashes of its halves: one edit
   leaves a half untouched, so a line that shares no half with another has no near copy.  Both are combined before they are sent:
   of equal lines the earliest, of equal halves one.
2. The lines that do share a half emit their deletion neighbourhood: the line itself and, for each unit, the hash of
   the line without it.  Equal variants meet; the positions of the deleted units verify the distance
   exactly (same position: one unit replaced; one side undeleted: one unit more or less).  Variants deleted
   at different places of equally long lines are two edits apart and are turned down.
3. An occurrence goes if an earlier one, by (doc_id, line number), is a copy of it.

Lines and variants are equal if their 128-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Packer, bloom, buckets, by_bucket, cut, packed_schema, unpack
from ._text import Segments, Words, chunks, member, mix, ranges, runs

NEAR = 8
ALIKE = 0.2  # share of the words of a document, from which lines that begin or end like one other document's make it its look-alike
SIZES = 0.6  # least ratio of the numbers of words of look-alikes
HOT = 4  # a half found in more than 1/HOT of a mean bucket is told apart; there are fewer of those than HOT times the buckets
HELD_LINES = 1_000_000  # lines that are combined before they are sent
SEEN_LINES = 100_000  # lines whose variants a partition knows that it has sent

_SALT = np.uint64(0xD6E8FEB86659FD93)
_SECOND = np.uint64(0xA0761D6478BD642F)
_WORD = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]"


class Lines:
    """The lines with words of some texts: rows, numbers, word ranges, and two hashes of each."""

    def __init__(self, texts: pa.Array):
        words = self.words = Words(texts)
        breaks = np.flatnonzero(words.data == 10)
        of_word = words.doc + np.searchsorted(breaks, words.start)
        self.start, self.n = runs(of_word)
        self.end = self.start + self.n
        self.doc = words.doc[self.start]
        self.no = of_word[self.start] - self.doc - np.searchsorted(breaks, words.off[self.doc])
        self.hash, self.second = (self.key(s(self.start, self.end), self.n) for s in (Segments(words.hash), Segments(mix(words.hash ^ _SECOND))))

    @staticmethod
    def key(h: np.ndarray, n: np.ndarray) -> np.ndarray:
        return mix(h + n.astype(np.uint64) * _SALT)

    def take_units(self, near: int) -> None:
        """unit_start and unit_n of each line, segs: hashes of stretches of the units, and kind: 1 for characters."""
        w = self.words
        self.kind = (self.n < near).astype(np.uint64)
        short = np.flatnonzero(self.kind)
        of = ranges(self.start[short], self.n[short])
        own = ranges(w.start[of], w.end[of] - w.start[of])
        lead = own[(w.data[own] & 0xC0) != 0x80]
        b0 = w.data[lead]
        size = 1 + (b0 >= 0xC0) + (b0 >= 0xE0) + (b0 >= 0xF0)
        point = b0.astype(np.uint64)
        for k in (1, 2, 3):
            point |= np.where(size > k, w.data[np.minimum(lead + k, len(w.data) - 1)], 0).astype(np.uint64) << np.uint64(8 * k)
        chars = np.searchsorted(lead, w.end[of]) - np.searchsorted(lead, w.start[of])
        space = np.ones(len(of), np.int64)
        begin = np.cumsum(self.n[short]) - self.n[short]
        space[begin] = 0
        ends = np.cumsum(chars + space)
        units = np.full(int(ends[-1]) if len(ends) else 0, np.uint64(32), np.uint64)
        units[ranges(ends - chars, chars)] = point
        edge = np.append(0, ends)
        self.unit_start, self.unit_n = self.start.copy(), self.n.copy()
        self.unit_start[short] = len(w) + edge[begin]
        self.unit_n[short] = edge[begin + self.n[short]] - edge[begin]
        every = np.concatenate([w.hash, mix(units + _SALT)])
        self.segs = Segments(every), Segments(mix(every ^ _SECOND))

    def halves(self, at: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
        """(line, key) of the untouched halves that a line has in common with any line one edit away."""
        lines, keys = [], []
        for less in (0, 1):  # as the shorter or equal line, and as the longer one
            i = at[self.unit_n[at] - less >= near]
            base = self.unit_n[i] - less
            m = base // 2
            s, e = self.unit_start[i], self.unit_start[i] + self.unit_n[i]
            for side, h in ((1, self.segs[0](s, s + m)), (2, self.segs[0](e - (base - m), e))):
                lines.append(i)
                keys.append(mix(h ^ mix(base.astype(np.uint64) * np.uint64(8) + np.uint64(side) + np.uint64(4) * self.kind[i])))
        return np.concatenate(lines), np.concatenate(keys)

    def variants(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(line, key, second key, deleted position): each line as it is, position -1, and without each of its units."""
        n, s = self.unit_n[at], self.unit_start[at]
        e = s + n
        pos = ranges(np.zeros_like(n), n)
        rs, re, rn, rk = np.repeat(s, n), np.repeat(e, n), np.repeat(n, n), np.repeat(self.kind[at], n)
        keys = []
        for seg in self.segs:
            rest = seg(rs, rs + pos) + (seg.sums[re] - seg.sums[rs + pos + 1]) * seg.down[rs + 1]
            keys.append(np.concatenate([self.key(seg(s, e) ^ self.kind[at], n), self.key(rest ^ rk, rn - 1)]))
        return np.concatenate([at, np.repeat(at, n)]), *keys, np.concatenate([np.full(len(at), -1), pos])


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where("doc_id is not null and text is not null")


def _rows(kind: int, doc: np.ndarray, no: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    k = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int32)), pa.array(doc), pa.array(no.astype(np.int32)), pa.array(h.view(np.int64))], names=["kind", "doc_id", "line_no", "hash"])


_OUT = "kind int, doc_id bigint, line_no int, hash bigint"


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _later(h: np.ndarray, second: np.ndarray, doc: np.ndarray, no: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(earliest occurrence of each line, occurrences of which there is an earlier one), as indices."""
    order = np.lexsort((no, doc, second, h))
    new = _new(h[order], second[order])
    first = order[new][np.cumsum(new) - 1] if len(order) else order
    return order[new], order[(doc[order] != doc[first]) | (no[order] != no[first])]


def _sharing(key: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, one line of each, lines that share a key with another line)."""
    order = np.lexsort((h, key))
    order = order[_new(key[order], h[order])]
    key, h = key[order], h[order]
    start, length = runs(key)
    return key[start], h[start], np.unique(h[np.repeat(length > 1, length)])


class _Held:
    """Columns of some chunks, until there are HELD_LINES rows."""

    def __init__(self) -> None:
        self.columns: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> bool:
        self.columns.append(columns)
        self.size += len(columns[0])
        return self.size >= HELD_LINES

    def take(self) -> list[np.ndarray]:
        out = [np.concatenate(c) for c in zip(*self.columns, strict=True)]
        self.columns, self.size = [], 0
        return out


def copies(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """(doc_id, line_no) of every line occurrence, numbered from 0, of which an earlier copy exists.

    Every line with a word takes part; lines without words never go.  doc_id is an integer, or a string of one; any other string is
    an error of the cast.  Rows without doc_id or text take no part.  Rows that share a doc_id share the fate of each line number:
    equal lines at one (doc_id, line number) tie, and none of them is earlier.  Long texts and long lines take part whole.
    Other columns are not read.  An empty table has no copies.
    """
    n = buckets(docs, 2)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, lines_held, halves_held = Packer(3 * n, ["a", "b", "c", "d"]), _Held(), _Held()

        def send_lines() -> Iterator[pa.RecordBatch]:
            h, second, doc, no = lines_held.take()
            first, gone = _later(h, second, doc, no)
            yield from packer.add(h[first] % np.uint64(n), h[first], second[first].view(np.int64), doc[first], no[first])
            yield from packer.add(2 * n + doc[gone] % n, h[gone], second[gone].view(np.int64), doc[gone], no[gone])

        def send_halves() -> Iterator[pa.RecordBatch]:
            key, h, known = _sharing(*halves_held.take())
            yield from packer.add(n + (key % np.uint64(n)).astype(np.int64), key, h.view(np.int64), np.zeros(len(key), np.int64), np.zeros(len(key), np.int32))
            # lines that share a half with another one here go along as such: of kind 1, behind the keys
            yield from packer.add(n + (known % np.uint64(n)).astype(np.int64), known, known.view(np.int64), np.zeros(len(known), np.int64), np.ones(len(known), np.int32))

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b in chunks(batch.column(1)):
                lines = Lines(batch.column(1)[a:b])
                lines.take_units(near)
                full = lines_held.add(lines.hash, lines.second, ids[a:b][lines.doc], lines.no.astype(np.int32))
                i, key = lines.halves(np.unique(lines.hash, return_index=True)[1], near)
                half_full = halves_held.add(key, lines.hash[i])
                if full:
                    yield from send_lines()
                if half_full:
                    yield from send_halves()
        if lines_held.columns:
            yield from send_lines()
            yield from send_halves() if halves_held.columns else ()
        yield from packer.flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {0: [], 1: []}
        for batch in batches:
            role = batch.column(0).to_numpy() // n
            for k in (0, 1):
                held[k].append(batch.filter(pa.array(role == k)))
            got = unpack(iter([batch.filter(pa.array(role == 2))]), {"a": "u8", "c": "i8", "d": "i4"})
            yield _rows(0, got["c"], got["d"], got["a"])
        got = unpack(iter(held[0]), {"a": "u8", "b": "u8", "c": "i8", "d": "i4"})
        later = _later(got["a"], got["b"], got["c"], got["d"])[1]
        yield _rows(0, got["c"][later], got["d"][later], got["a"][later])
        got = unpack(iter(held[1]), {"a": "u8", "b": "u8", "d": "i4"})
        key = got["d"] == 0
        h = np.unique(np.concatenate([_sharing(got["a"][key], got["b"][key])[2], got["b"][~key]]))
        yield _rows(1, np.zeros(len(h), np.int64), np.zeros(len(h), np.int32), h)

    texts = _texts(docs)
    met = cut(by_bucket(texts.mapInArrow(hashes, packed_schema(["a", "b", "c", "d"])), 3 * n).mapInArrow(meet, _OUT))
    exact = met.where("kind = 0").select("doc_id", "line_no")
    return exact.union(_near(texts, met.where("kind = 1").select("hash"), n, near)).distinct()


def _near(texts: DataFrame, sharing: DataFrame, n: int, near: int) -> DataFrame:
    maybe = texts.sparkSession.sparkContext.broadcast(bloom(sharing.distinct(), "hash"))
    names = ["key", "key2", "hash", "doc", "no", "pos"]

    def neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(n, names)
        seen = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # lines that were sent lately
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b in chunks(batch.column(1)):
                lines = Lines(batch.column(1)[a:b])
                lines.take_units(near)
                doc = ids[a:b][lines.doc]
                at = np.flatnonzero((lines.unit_n >= near) & maybe.value.test(lines.hash))
                at = at[_later(lines.hash[at], lines.second[at], doc[at], lines.no[at])[0]]
                # an occurrence goes out only if no earlier one did
                known = [np.concatenate(c) for c in zip(seen, (lines.hash[at], lines.second[at], doc[at], lines.no[at]), strict=True)]
                first = _later(*known)[0]
                at = at[first[first >= len(seen[0])] - len(seen[0])]
                seen = [c[first] for c in known] if len(first) < SEEN_LINES else [c[:0] for c in seen]
                i, key, key2, pos = lines.variants(at)
                yield from packer.add(key % np.uint64(n), key, key2, lines.hash[i], doc[i], lines.no[i].astype(np.int32), pos.astype(np.int32))
        yield from packer.flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = unpack(batches, {"key": "u8", "key2": "u8", "hash": "u8", "doc": "i8", "no": "i4", "pos": "i4"})
        order = np.lexsort((got["no"], got["doc"], got["hash"], got["pos"], got["key2"], got["key"]))
        key, key2, h, doc, no, pos = (got[k][order] for k in names)
        new = _new(key, key2, pos, h)  # each variant of each line once, at the line's earliest occurrence
        key, key2, h, doc, no, pos = (x[new] for x in (key, key2, h, doc, no, pos))
        group = np.cumsum(_new(key, key2))
        out = []
        # one unit replaced: same variant, same place
        order = np.lexsort((no, doc, pos, group))
        first = _new(group[order], pos[order])
        head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else order
        later = ~first & (h[order] != h[order][head]) & (pos[order] >= 0)
        later &= (doc[order] != doc[order][head]) | (no[order] != no[order][head])
        out.append(order[later])
        # one unit more or less: the undeleted line comes first in its run of the key, as its position is -1
        start, length = runs(group)
        some = (length > 1) & (pos[start] == -1)
        full, count = start[some], length[some]
        others = ranges(full + 1, count - 1)
        owner = np.repeat(full, count - 1)
        before = (doc[owner] < doc[others]) | ((doc[owner] == doc[others]) & (no[owner] < no[others]))
        after = (doc[owner] > doc[others]) | ((doc[owner] == doc[others]) & (no[owner] > no[others]))
        out += [others[before], owner[after]]
        at = np.unique(np.concatenate(out))
        yield _rows(2, doc[at], no[at], h[at])

    packed = texts.mapInArrow(neighbourhoods, packed_schema(names))
    return cut(by_bucket(packed, n).mapInArrow(meet, _OUT).select("doc_id", "line_no").distinct())


def _voters(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, doc, no, words, total) of the halves of each line: its document, number and words, and the words of the document."""
    ids = batch.column(0).to_numpy()
    for a, b in chunks(batch.column(1)):
        lines = Lines(batch.column(1)[a:b])
        lines.take_units(NEAR)
        total = np.diff(lines.words.bound)[lines.doc].astype(np.int32)
        i, key = lines.halves(np.arange(len(lines.n)), 2)
        k = len(i) - 2 * int((lines.unit_n >= 3).sum())  # those of equally long lines come first
        i, key = i[:k], key[:k]
        yield key, ids[a:b][lines.doc[i]], lines.no[i].astype(np.int32), lines.n[i].astype(np.int32), total[i]


def _hot_halves(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first document, its words) of the halves that are too frequent for one of n buckets, fewer than HOT * n, sorted.

    A key with a share of all is found with that share in some stretch of HELD_LINES, so only those are counted.
    """
    most = HOT * n

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()

        def counted() -> Iterator[pa.RecordBatch]:
            key = np.sort(held.take()[0])
            start, count = runs(key)
            some = count > len(key) / most
            keys, total = pa.array(key[start[some]].view(np.int64)), pa.array([None], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([keys, total]), pa.array(np.append(count[some], len(key)))], names=["key", "n"])

        for batch in batches:
            for key, *_ in _voters(batch):
                if held.add(key):
                    yield from counted()
        if held.size:
            yield from counted()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = hot.value
        best, size = np.full(len(keys), np.iinfo(np.int64).max), np.zeros(len(keys), np.int32)
        seen = np.zeros(len(keys), bool)
        for batch in batches:
            for key, doc, _, _, total in _voters(batch):
                at = member(key, keys)
                at, doc, total = at[at >= 0], doc[at >= 0], total[at >= 0]
                order = np.lexsort((total, doc, at))
                order = order[_new(at[order])]
                at, doc, total = at[order], doc[order], total[order]
                less = ~seen[at] | (doc < best[at]) | ((doc == best[at]) & (total < size[at]))
                best[at[less]], size[at[less]], seen[at] = doc[less], total[less], True
        yield pa.RecordBatch.from_arrays([pa.array(keys[seen].view(np.int64)), pa.array(best[seen]), pa.array(size[seen])], names=["key", "doc", "total"])

    counts = cut(texts.mapInArrow(frequent, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")))
    total = counts.where("key is null").agg(F.sum("n")).first()[0] or 0
    keys = np.sort(counts.where(F.col("key").isNotNull() & (F.col("n") > total / most)).select("key").toArrow().column(0).to_numpy().view(np.uint64))
    if not len(keys):
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int32)
    hot = texts.sparkSession.sparkContext.broadcast(keys)
    found = texts.mapInArrow(first, "key bigint, doc bigint, total int").groupBy("key").agg(F.min(F.struct("doc", "total")).alias("first"))
    table = found.select("key", "first.doc", "first.total").toArrow()
    key, doc, size = (table.column(i).to_numpy() for i in range(3))
    order = np.argsort(key.view(np.uint64))
    return key.view(np.uint64)[order], doc[order], size[order]


def look_alikes(docs: DataFrame, share: float = ALIKE, sizes: float = SIZES) -> DataFrame:
    """doc_id of the documents that look like near copies of one earlier document as a whole.

    A line speaks for the first document with a line of as many units and an equal half.  A document is found if lines
    with `share` of its words speak for one earlier document, and of the numbers of words of both the smaller is at least `sizes` of
    the larger; of rows that share the id of the first document the shortest counts.  Halves meet in buckets by their hash; those too frequent for
    one bucket are few, so that their first documents are sent to all lines instead.
    Ids, nulls, repeated rows, long texts, columns and empty tables are as in copies().
    """
    n = buckets(docs, 2)
    names, votes = ["key", "doc", "no", "words", "total"], ["doc", "no", "words", "total", "source"]
    texts = _texts(docs)
    hot = texts.sparkSession.sparkContext.broadcast(_hot_halves(texts, n))

    def speaks(doc: np.ndarray, total: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (doc != first) & (np.minimum(total, size) >= sizes * np.maximum(total, size))

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(2 * n, names)
        keys, first, size = hot.value
        for batch in batches:
            for columns in _voters(batch):
                at = member(columns[0], keys)
                known = at >= 0
                key, *rest = (c[~known] for c in columns)
                yield from packer.add(key % np.uint64(n), key, *rest)
                _, doc, no, words, total = (c[known] for c in columns)
                at = at[known]
                good = speaks(doc, total, first[at], size[at])
                yield from packer.add(n + doc[good] % n, first[at[good]].view(np.uint64), doc[good], no[good], words[good], total[good])
        yield from packer.flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            known = batch.filter(pc.greater_equal(batch.column(0), n))  # the first document in place of the key
            held.append(batch.filter(pc.less(batch.column(0), n)))
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([pc.subtract(known.column(0), pa.scalar(n, pa.int32())), *known.columns[2:], known.column(1)], names=["bucket", *votes])
        got = unpack(iter(held), {"key": "u8", "doc": "i8", "no": "i4", "words": "i4", "total": "i4"})
        key, doc, no, words, total = (got[k] for k in names)
        order = np.lexsort((total, doc, key))
        new = _new(key[order])
        first = order[new][np.cumsum(new) - 1] if len(order) else order
        good = speaks(doc[order], total[order], doc[first], total[first])
        own, first = order[good], first[good]
        packer = Packer(n, votes)
        yield from packer.add(doc[own] % n, doc[own], no[own], words[own], total[own], doc[first])
        yield from packer.flush()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = unpack(batches, {"doc": "i8", "no": "i4", "words": "i4", "total": "i4", "source": "i8"})
        order = np.lexsort((got["no"], got["source"], got["doc"]))
        doc, no, words, total, source = (got[k][order] for k in ("doc", "no", "words", "total", "source"))
        new = _new(doc, source, no)
        doc, words, total, source = doc[new], words[new], total[new], source[new]
        start = np.flatnonzero(_new(doc, source))
        enough = np.add.reduceat(words, start) >= share * total[start] if len(start) else start.astype(bool)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(doc[start][enough]))], names=["doc_id"])

    met = by_bucket(texts.mapInArrow(halves, packed_schema(names)), 2 * n).mapInArrow(meet, packed_schema(votes))
    return by_bucket(met, n).mapInArrow(weigh, "doc_id bigint").distinct()


def _cut(docs: DataFrame, near: int, whole: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """(row, text, dropped): each row as a struct, so that no name clashes, its text without copied lines, and how many went."""
    gone = copies(docs, near).groupBy("doc_id").agg(F.collect_list("line_no").alias("gone"))
    if whole is None:
        gone = gone.withColumn("whole", F.lit(False))
    else:
        gone = gone.join(whole(docs).select("doc_id", F.lit(True).alias("whole")), "doc_id", "left")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(gone, F.col("row.doc_id").cast("long") == F.col("doc_id"), "left").withColumn("parts", F.split(F.col("row.text").cast("string"), "\n"))
    numbers: Column = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    rows = rows.withColumn("rest", F.array_join(F.transform(numbers, lambda i: F.get("parts", i)), "\n"))
    same = F.col("gone").isNull() | F.col("row.text").isNull() | (F.coalesce("whole", F.lit(False)) & F.col("rest").rlike(_WORD))
    return rows.select("row", F.when(same, F.col("row.text").cast("string")).otherwise(F.col("rest")).alias("text"), F.when(same, F.lit(0)).otherwise(F.size("gone")).alias("dropped"))


def without_copies(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """The rows of `docs`, all columns kept, with the copied lines taken out of `text`, and a count `n_dropped`.

    A null or empty text stays as it is, with n_dropped 0, as does a row without doc_id.  A text all of whose
    lines go becomes the empty text.  Lines are split at the line feed alone, and kept lines keep their bytes.
    A column of `docs` that is itself named n_dropped is replaced.
    """
    columns = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c != "n_dropped"]
    return _cut(docs, near, None).select(*columns, F.col("dropped").alias("n_dropped"))


def cleaned(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """The documents without copied lines, and without those of which nothing else is left; columns as they were.

    The number of characters in n_chars, if there is such a column, follows the text.  Documents that look_alikes() finds keep their
    lines, unless every line with words is a copy: near copies of a whole document are for the join of documents to remove, which would
    no longer know their remains.  Rows without doc_id or text stay, and empty or blank texts too.
    """
    kept = _cut(docs, near, look_alikes).where("dropped = 0 or trim(both ' \t\r\n' from text) <> ''")
    made = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return kept.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_dropped) of every document of the table; see without_copies()."""
    return without_copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "n_dropped")
