"""N-gram Jaccard self-join with token-combination prefixes.

A document is the set of its word n-grams (tokens).  All pairs with Jaccard similarity >= t are found exactly:

1. One scan gives each document a content id (hash and size of its set) and each partition's frequent tokens.
   A token that is frequent in the corpus is frequent in some partition, so their union, with counts summed over all
   partitions, is the table of frequent tokens, of which the MOST_FREQUENT are kept.  The same goes for words.  Any table gives
   the same pairs; a good one gives few candidates.
2. Tokens that aren't frequent come first, those of rare words before those of frequent words, then the frequent ones by
   growing frequency.  A set x must share more than it can miss,
   p - 1 = |x| - ceil(t|x|) tokens, so its prefix is extended until p misses are needed to destroy every
   signature in it: a rare token is a signature alone (weight 1); frequent tokens are split into groups, and a group
   of c tokens from a class of k-token combinations weighs c - k + 1.
   Of two sets, the prefix that ends first in the order keeps a whole signature inside the
   other prefix; so equal signatures find every pair.
   Groups grow in number with the set (levels), so that combinations stay proportional to the tokens; a pair
   meets at the level of its smaller set, and a set emits at every level its partners can have.
3. Equal signatures meet in one partition; sets of equal content count once; size and position bounds are applied.  Each
   set names its three least signatures, and a pair is left to the least that both name.  Combinations that many sets share
   have their pairs collected as bits, so that a pair of a large group isn't met once for each of the combinations it has in common.
4. Candidates whose parity sketches differ in more places than the sets may are dropped; the token sets of the others
   are verified.  Either is done in tiles: a pair goes to the tile of the least neighbour of both, which the sets of a group mostly have
   in common, so that few tiles need the same set.  A set with many candidates splits its tiles into blocks of both sides, so that
   none of them is large, however large the group.  Sketches and sets are sent once to each tile that needs them.
5. Of the similar pairs in a tile only the sum of links of each set and a star of each connected part leave it: what follows is
   linear in the documents, whatever the number of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import bloom, by_bucket, cut, packed_schema, partitions, unpack
from ._text import HASH, Segments, Words, chunks, flat, member, mix, ngram_sets, ngrams, ranges, runs

N = 2
THRESHOLD = 0.6
FREQUENT = 0.0002  # share of a partition's documents, 3 at least, from which a token is frequent: pairs of tokens
VERY_FREQUENT = 0.02  # share of all documents from which triples are used
LEAST_FREQUENT = 8  # documents
MOST_FREQUENT = 1_000_000  # tokens in the broadcast table, 16 MB
BROADCAST_ROWS = 1_000_000  # of (set, tile), 40 MB; beyond that the sets are shuffled to their tiles in two steps
COUNTED = 2_000_000  # values that a partition counts between two folds; it keeps twice as many at most, but for those seen again
TILE_SETS = 1024  # candidates of a set from which its tiles are split into blocks
TILE_BYTES = 16 << 20  # of sketches, sets and pairs that are in work at once, where a tile isn't larger
PART_BYTES = 96 << 20  # of signatures or sets in one partition
LEAST_PARITIES = 256  # bits of a sketch; larger sets have 1.25 to 2.5 bits a token
SET_BYTES = 6  # of each token's hash in verification
SIGNATURE_BYTES = 8  # for each token of a set, by experience
FREQUENT_WORD = 0.0001  # share of all words; the rarer ones count alike


_OTHER = np.uint64(0x5851F42D4C957F2D)


def _ceil(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.round(x, 9)).astype(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where("doc_id is not null and text is not null")


def _parts(docs: DataFrame, size: int) -> int:
    return int(min(60_000, max(1, partitions(docs.sparkSession) // 4, size // PART_BYTES)))


class WordLevels:
    """How often a word occurs, as a small number: 0 below FREQUENT_WORD, and 1 more at each doubling."""

    def __init__(self, words: np.ndarray, share: np.ndarray, least: float):
        order = np.argsort(words)
        self.words = words[order]
        self.level = np.append(np.clip(np.log2(share[order] / least) + 1, 1, 31).astype(np.int64), 0)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        return self.level[member(words, self.words)]


class Sets:
    """The token sets of at most DOCS texts."""

    def __init__(self, texts: pa.Array, n: int, words: WordLevels | None = None):
        self.row, self.token = ngram_sets(texts, n, words)
        self.bound = np.searchsorted(self.row, np.arange(len(texts) + 1))
        self.size = np.diff(self.bound)
        self.id = mix(self._sum(np.uint64(0)) ^ mix(self.size.astype(np.uint64)))

    def _sum(self, salt: np.uint64) -> np.ndarray:
        sums = np.zeros(len(self.token) + 1, np.uint64)
        np.cumsum(mix((self.token & HASH) ^ salt), out=sums[1:])
        return sums[self.bound[1:]] - sums[self.bound[:-1]]

    def other(self) -> np.ndarray:
        """A second content id, of other hashes of the tokens."""
        return mix(self._sum(_OTHER))

    def sketches(self, some: np.ndarray) -> list[bytes]:
        """The parities of hash buckets, of the rows `some`.

        Each token of one set that isn't in the other flips one parity, so the parities of two sets differ in at most
        as many places as the sets have tokens that aren't shared.
        """
        h = mix(self.token & HASH)
        places = np.maximum(LEAST_PARITIES, 2 ** np.ceil(np.log2(np.maximum(1.25 * self.size, 1))).astype(np.int64))
        base = np.concatenate([[0], np.cumsum(places)])
        at = base[self.row] + ((h >> np.uint64(20)).astype(np.int64) & (places[self.row] - 1))
        bits = np.packbits((np.bincount(at, minlength=base[-1]) & 1).astype(bool))
        return [bits[base[i] >> 3 : base[i + 1] >> 3].tobytes() for i in some.tolist()]


def verified_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct token hashes of some texts, of 8 * SET_BYTES bits, one after the other, and where each begins."""
    words = Words(texts)
    at, h = ngrams(words, n)
    doc = words.doc[at]
    count = np.diff(words.bound)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        lo, hi = words.bound[short], words.bound[short + 1]
        h = np.concatenate([h, mix(Segments(words.hash)(lo, hi) + count[short].astype(np.uint64))])
        doc = np.concatenate([doc, short])
    h = mix(h) >> np.uint64(64 - 8 * SET_BYTES)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


class _Counter:
    """Counts of 64-bit values, folded together now and then; when there are many, those seen once so far are forgotten."""

    def __init__(self) -> None:
        self.value, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.held: list[np.ndarray] = []
        self.size = self.total = 0

    def add(self, values: np.ndarray) -> None:
        self.held.append(values)
        self.size += len(values)
        self.total += len(values)
        if self.size > COUNTED:
            self.fold()

    def fold(self) -> None:
        fresh = np.concatenate([np.zeros(0, np.uint64), *self.held])
        fresh.sort()
        start, count = runs(fresh)
        self.held, self.size = [], 0
        if not len(self.value):
            self.value, self.count = fresh[start], count
            return
        value, count = np.concatenate([self.value, fresh[start]]), np.concatenate([self.count, count])
        order = np.argsort(value, kind="stable")
        start = runs(value[order])[0]
        self.value = value[order][start]
        self.count = np.add.reduceat(count[order], start) if len(start) else count
        if len(self.value) > 2 * COUNTED:
            often = self.count > 1
            self.value, self.count = self.value[often], self.count[often]

    def least(self, count: float) -> tuple[np.ndarray, np.ndarray]:
        self.fold()
        often = self.count >= count
        return self.value[often], self.count[often]


def _statistics(docs: DataFrame, n: int, frequent: float, frequent_word: float) -> DataFrame:
    """kind 0: (doc_id, content id, size, other content id, sketch) of each text with words; 1: (token, documents) frequent in a
    partition; 2: (word, occurrences) frequent in a partition; 3: (0, words) of a partition."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens, words = 0, _Counter(), _Counter()

        def rows(kind: int, *columns: np.ndarray | pa.Array, sketch: list[bytes] | None = None) -> pa.RecordBatch:
            k = len(columns[0])
            made = [c if isinstance(c, pa.Array) else pa.array(c.view(np.int64)) for c in columns]
            made += [pa.nulls(k, pa.int64())] * (4 - len(made))
            return pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int32)), *made, pa.array(sketch or [None] * k, pa.binary())], names=["kind", "a", "b", "size", "other", "sketch"])

        for batch in batches:
            ids = batch.column(0)
            for a, b in chunks(batch.column(1)):
                words.add(Words(batch.column(1)[a:b]).hash)
                sets = Sets(batch.column(1)[a:b], n)
                tokens.add(sets.token)
                total += b - a
                some = np.flatnonzero(sets.size)
                yield rows(0, ids[a:b].take(pa.array(some)), sets.id[some], sets.size[some], sets.other()[some], sketch=sets.sketches(some))
        for kind, (value, count) in ((1, tokens.least(max(3, frequent * total))), (2, words.least(max(2, frequent_word * words.total)))):
            yield rows(kind, value, count)
        yield rows(3, np.zeros(1, np.int64), np.array([words.total]))

    return _texts(docs).mapInArrow(of, "kind int, a bigint, b bigint, size bigint, other bigint, sketch binary")


def level(size: int) -> int:
    """0 below 16 tokens, then one more at each doubling."""
    return max(0, int(size).bit_length() - 4)


def combination_signatures(tokens: np.ndarray, classes: np.ndarray, rare: int, wanted: int, at: int) -> list[int]:
    """Signatures, at one level, of the frequent tokens (in order) that the prefix needs beyond `rare` rare tokens."""
    groups: dict[tuple[int, int], list[int]] = {}
    weight = rare
    for token, k in zip(tokens.tolist(), classes.tolist(), strict=True):
        if weight >= wanted:
            break
        if at == 0:
            k, g = 1, 0
        else:
            g = token * 0x9E3779B97F4A7C15 % 2**64 % ((1 << at) if k == 2 else (1 << (at - 1)))
        group = groups.setdefault((k, g), [])
        group.append(token)
        weight += len(group) >= k
    out = []
    for (k, g), members in groups.items():
        salt = (k << 40) ^ (g << 8) ^ at
        for some in combinations(sorted(members), k):
            h = salt * 0xD6E8FEB86659FD93
            for t in some:
                h = (h ^ t) * 0x2545F4914F6CDD1D % 2**64
                h ^= h >> 29
            out.append(h % 2**64)
    return out


def signatures(sets: Sets, table: np.ndarray, count: np.ndarray, many: float, t: float) -> tuple[np.ndarray, ...]:
    """(row, signature, position) of the extended prefixes; the position is -1 for combinations."""
    at = member(sets.token & HASH, table)
    rare = at < 0
    wanted = sets.size - _ceil(t * sets.size) + 1
    before = np.concatenate([[0], np.cumsum(rare)])
    rank = before[:-1] - before[sets.bound[:-1]][sets.row]
    take = rare & (rank < wanted[sets.row])
    out_row, out_sig, out_pos = [sets.row[take]], [mix(sets.token[take])], [rank[take]]
    n_rare = before[sets.bound[1:]] - before[sets.bound[:-1]]
    for i in np.flatnonzero((n_rare < wanted) & (sets.size > 0)).tolist():
        own = slice(sets.bound[i], sets.bound[i + 1])
        often = np.flatnonzero(~rare[own])
        token, c = sets.token[own][often], count[at[own][often]]
        order = np.lexsort((token, c))
        token, k = token[order], np.where(c[order] >= many, 3, 2)
        size = int(sets.size[i])
        for lv in range(level(int(_ceil(np.array(t * size)))), level(size) + 1):
            sig = combination_signatures(token, k, int(n_rare[i]), int(wanted[i]), lv)
            out_row.append(np.full(len(sig), i))
            out_sig.append(np.array(sig, np.uint64))
            out_pos.append(np.full(len(sig), -1))
    row, sig, pos = np.concatenate(out_row), np.concatenate(out_sig), np.concatenate(out_pos)
    return row, sig, pos


WIDE = 64  # sets that share a combination, from which their pairs are collected as bits
BLOCK_BYTES = 16 << 20  # of these bits at once
PARTS = 8  # shares in which a partition joins its signatures
NONE = np.uint32(0xFFFFFFFF)


def owners(row: np.ndarray, sig: np.ndarray, pos: np.ndarray, size: np.ndarray) -> np.ndarray:
    """low[i]: the three least hashes of the signatures in the first eighth of set i and of its combinations; NONE where there are fewer."""
    own = np.flatnonzero(8 * pos < size[row])
    key = (row[own].astype(np.uint64) << np.uint64(32)) | rank_of(sig[own])
    key.sort()
    doc = (key >> np.uint64(32)).astype(np.int64)
    start, length = runs(doc)
    place = ranges(np.zeros(len(start), np.int64), length)
    first = place < 3
    low = np.full((len(size), 3), NONE)
    low[doc[first], place[first]] = (key[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return low


def rank_of(sig: np.ndarray) -> np.ndarray:
    return (sig >> np.uint64(16)) & np.uint64(0xFFFFFFFF)


def wide_pairs(who: np.ndarray, size: np.ndarray, row: np.ndarray, length: np.ndarray, low: np.ndarray, rank: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x, y) of `who` that are in some run together and whose sizes fit; the runs have `length` rows each, `rank` each one's signature.

    Near copies share hundreds of combinations, so each pair of a large group would be met as often.  Here a run costs a bit for each pair
    of its members and the group it belongs to, and each pair leaves once; those that name a signature of another run are left to it.
    """
    start = np.cumsum(length) - length
    ids, first, at = np.unique(who, return_index=True, return_inverse=True)
    part = np.arange(len(ids))
    while True:
        least = np.repeat(np.minimum.reduceat(part[at], start), length)
        new = part.copy()
        np.minimum.at(new, at, least)
        new = new[new]
        if (new == part).all():
            break
        part = new
    order = np.lexsort((ids, size[first], part))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    at, ids, part, size, names = place[at], ids[order], part[order], size[first[order]], low[row[first[order]]]
    rank = np.unique(rank)
    begin, count = runs(part)
    of = np.searchsorted(begin, at[start], "right") - 1
    by = np.argsort(of, kind="stable")
    edge = np.searchsorted(of[by], np.arange(len(begin) + 1))
    for p, (b, m) in enumerate(zip(begin.tolist(), count.tolist(), strict=True)):
        block = max(1, 8 * BLOCK_BYTES // m)
        for lo in range(0, m, block):
            bits = np.zeros((min(block, m - lo), -(-m // 8)), np.uint8)
            for r in by[edge[p] : edge[p + 1]].tolist():
                some = at[start[r] : start[r] + length[r]] - b
                mask = np.zeros(m, bool)
                mask[some] = True
                bits[some[(some >= lo) & (some < lo + len(bits))] - lo] |= np.packbits(mask)
            step = max(1, 500_000 // m)
            for i in range(0, len(bits), step):
                x, y = np.nonzero(np.unpackbits(bits[i : i + step], axis=1, count=m))
                x += lo + i
                x, y = b + x[x < y], b + y[x < y]
                fits = size[x] >= np.round(t * size[y], 9)
                x, y = x[fits], y[fits]
                need = _ceil(t / (1 + t) * (size[x] + size[y]))
                common = np.full(len(x), NONE)
                for k in range(3):
                    for j in range(3):
                        common = np.where(names[x, k] == names[y, j], np.minimum(common, names[x, k]), common)
                elsewhere = (common != NONE) & (7 * size[x] >= 8 * need) & (7 * size[y] >= 8 * need)
                elsewhere[elsewhere] = member(common[elsewhere].astype(np.uint64), rank) < 0
                yield ids[x[~elsewhere]], ids[y[~elsewhere]]


class _Sender:
    """Packs signatures by bucket, with the data of a set once for each bucket that it has signatures in."""

    names = ("id", "size", "low", "n", "sig", "pos")

    def __init__(self, parts: int, limit: int = 2_000_000):
        self.parts, self.limit = parts, limit
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.sets: list[tuple[np.ndarray, ...]] = []
        self.n_rows = self.n_sets = 0

    def add(self, sets: Sets, row: np.ndarray, sig: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        short = np.ascontiguousarray(sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])  # 48 bits tell signatures apart
        self.rows.append((((sig & np.uint64(0xFFFF)) % np.uint64(self.parts)).astype(np.uint16), (row + self.n_sets).astype(np.int32), short, np.minimum(pos + 1, 65535).astype(np.uint16)))  # a position that is cut off lets more pass
        self.sets.append((sets.id, sets.size.astype(np.int32), owners(row, sig, pos, sets.size)))
        self.n_rows += len(row)
        self.n_sets += len(sets.id)
        if self.n_rows > self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n_rows:
            return
        bucket, of, sig, pos = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        who, size, low = (np.concatenate(x) for x in zip(*self.sets, strict=True))
        self.rows, self.sets, self.n_rows, self.n_sets = [], [], 0, 0
        order = np.argsort(bucket, kind="stable")
        bucket, of, sig, pos = bucket[order], of[order], sig[order], pos[order]
        head = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (of[1:] != of[:-1])]))
        n = np.diff(np.append(head, len(of))).astype(np.int32)
        at = of[head]
        columns = {"id": who[at], "size": size[at], "low": low[at], "n": n, "sig": sig, "pos": pos}
        every = np.arange(self.parts + 1)
        edges = {True: np.searchsorted(bucket[head], every), False: np.searchsorted(bucket, every)}
        full = np.flatnonzero(np.diff(edges[False]))
        out = [pa.array(full.astype(np.int32))]
        for name in self.names:
            e, c = edges[name not in ("sig", "pos")], columns[name]
            out.append(pa.array([c[e[k] : e[k + 1]].tobytes() for k in full], pa.binary()))
        yield pa.RecordBatch.from_arrays(out, names=["bucket", *self.names])


def _candidates(docs: DataFrame, n: int, t: float, table: np.ndarray, count: np.ndarray, words: WordLevels, many: float, tokens: int) -> DataFrame:
    """Distinct pairs (x, y) of content ids that share a signature and pass the bounds; tokens: of all sets."""
    # what a set says of itself is repeated in each bucket
    parts = _parts(docs, SIGNATURE_BYTES * tokens)
    shared = docs.sparkSession.sparkContext.broadcast((table, count, words))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(parts)
        table, count, words = shared.value
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                sets = Sets(batch.column(1)[a:b], n, words)
                yield from sender.add(sets, *signatures(sets, table, count, many, t))
        yield from sender.flush()

    def join(sig: np.ndarray, head: np.ndarray, pos: np.ndarray, content: np.ndarray, sizes: np.ndarray, low: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(sig, kind="stable")
        start, length = runs(sig[order])
        order = order[np.repeat(length > 1, length)]  # most signatures are met once
        sig, pos, head = sig[order], pos[order], head[order]
        who, size = content[head], sizes[head].astype(np.int64)
        order = np.lexsort((who, size, sig))
        order = order[np.concatenate([[True], (np.diff(sig[order]) != 0) | (np.diff(who[order]) != 0)])] if len(order) else order
        sig, who, size, pos, head = (x[order] for x in (sig, who, size, pos, head))
        rank = rank_of(sig)
        start, length = runs(sig)
        found, held = [np.zeros(0, np.uint64)], 0
        wide = length >= WIDE
        if wide.any():
            wide &= np.maximum.reduceat(pos, start) < 0
            rows = np.repeat(wide, length)
            for x, y in wide_pairs(who[rows], size[rows], head[rows], length[wide], low, rank[start[wide]], t):
                x, y = x.astype(np.uint64), y.astype(np.uint64)
                found.append((np.minimum(x, y) << np.uint64(32)) | np.maximum(x, y))
            sig, who, size, pos, head, rank = (x[~rows] for x in (sig, who, size, pos, head, rank))
            start, length = runs(sig)
        last = np.repeat(start + length, length) - 1
        active, d = np.arange(len(sig)), 1
        while len(active):
            active = active[active + d <= last[active]]
            other = active + d
            fits = size[active] >= np.round(t * size[other], 9)  # ascending sizes: later ones fit even less
            active, other = active[fits], other[fits]
            need = _ceil(t / (1 + t) * (size[active] + size[other]))
            good = (pos[active] <= size[active] - need) & (pos[other] <= size[other] - need)
            # a pair is left to the least signature that both name, if its bounds hold there for certain
            left = np.flatnonzero(good & (7 * size[active] >= 8 * need) & (7 * size[other] >= 8 * need))
            if len(left):
                u, v, own = low[head[active[left]]], low[head[other[left]]], rank[active[left]]
                better = np.zeros(len(left), bool)
                for i in range(3):
                    ahead = u[:, i] < own
                    for j in range(3):
                        better |= ahead & (u[:, i] == v[:, j])
                good[left[better]] = False
            x, y = who[active[good]].astype(np.uint64), who[other[good]].astype(np.uint64)
            found.append((np.minimum(x, y) << np.uint64(32)) | np.maximum(x, y))
            held += len(x)
            if held > 4_000_000:
                found, held = [np.unique(np.concatenate(found))], 0
            d += 1
        pair = np.unique(np.concatenate(found))
        x, y = ids[(pair >> np.uint64(32)).astype(np.int64)], ids[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        return x, y

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = unpack(batches, {"id": "u8", "size": "i4", "low": "u4", "n": "i4", "sig": "u1", "pos": "u2"})
        place = got["pos"].astype(np.int32) - 1
        wide = np.zeros((len(place), 8), np.uint8)
        wide[:, :6] = got["sig"].reshape(-1, 6)
        every = wide.view("<u8")[:, 0]
        ids, content = np.unique(got["id"], return_inverse=True)
        heads = np.repeat(np.arange(len(got["n"]), dtype=np.int32), got["n"])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for part in range(PARTS):  # one share of the signatures after the other, to hold less at once
            own = np.flatnonzero((every >> np.uint64(44)) % np.uint64(PARTS) == part)
            x, y = join(every[own], heads[own], place[own], content, got["size"], got["low"].reshape(-1, 3), ids)
            found.append((x, y))
            if part == PARTS - 1 or sum(len(x) for x, _ in found) > 4_000_000:
                x, y = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.lexsort((y, x))
                x, y, found = x[order], y[order], []
                new = np.ones(len(x), bool)
                new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(x[new].view(np.int64)), pa.array(y[new].view(np.int64))], names=["x", "y"])

    packed = _texts(docs).mapInArrow(emit, packed_schema(list(_Sender.names)))
    return by_bucket(packed, parts).mapInArrow(meet, "x bigint, y bigint").repartition(partitions(docs.sparkSession), "x").distinct()


Pairs = list[np.ndarray]
_TILED = ("tile", "x", "y", "a", "b", "data")


def _by_tile(work: Callable[[pa.Table, np.ndarray], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gives `work` the sets (x, a, b, data) and the pairs (x, y) of some whole tiles at a time, from rows sorted by tile."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[pa.RecordBatch] = []
        pairs: Pairs = [np.zeros((2, 0), np.int64)]
        size, last = 0, None

        def hold(b: pa.RecordBatch) -> None:
            nonlocal size
            own = b.filter(b.column("data").is_null())
            sets.append(b.filter(b.column("data").is_valid()))
            pairs.append(np.stack([own.column(c).to_numpy() for c in ("x", "y")]))
            size += sets[-1].nbytes + pairs[-1].nbytes

        for b in batches:
            tile = b.column("tile").to_numpy()
            if size >= TILE_BYTES and len(tile):
                end = int(np.count_nonzero(tile == last))  # the rest of the tile that is open
                hold(b.slice(0, end))
                b = b.slice(end)
                if len(b):
                    yield work(pa.Table.from_batches(sets), np.concatenate(pairs, axis=1))
                    sets, pairs, size = [], [np.zeros((2, 0), np.int64)], 0
            if len(b):
                hold(b)
                last = tile[-1]
        if sets:
            yield work(pa.Table.from_batches(sets), np.concatenate(pairs, axis=1))

    return of


def _distinct(sets: pa.Table, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, a, b, bytes, offsets) of the sets, each once, and the pairs as two columns of their positions."""
    ids, pick = np.unique(sets["x"].to_numpy(), return_index=True)
    data, off = flat(sets["data"].take(pa.array(pick)))
    x, y = np.searchsorted(ids, pairs)
    return ids, sets["a"].to_numpy()[pick], sets["b"].to_numpy()[pick], data, off, x, y


def _alike(t: float) -> Callable[[pa.Table, np.ndarray], pa.RecordBatch]:
    """The pairs whose sketches don't rule out the similarity t; a: the size of a set, data: its sketch."""

    def work(sets: pa.Table, pairs: np.ndarray) -> pa.RecordBatch:
        ids, size, _, data, off, x, y = _distinct(sets, pairs)
        width = np.diff(off)
        swap = width[x] < width[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        need = _ceil(t / (1 + t) * (size[x] + size[y]))
        differ = np.empty(len(x), np.int64)
        for wide, narrow in {(int(p), int(q)) for p, q in zip(*np.unique(np.stack([width[x], width[y]]), axis=1), strict=True)} if len(x) else ():
            own = np.flatnonzero((width[x] == wide) & (width[y] == narrow))
            rows = {w: np.flatnonzero(width == w) for w in (wide, narrow)}
            bits = {w: data[ranges(off[r], width[r])].reshape(len(r), w // narrow, narrow) for w, r in rows.items()}
            folded = {w: np.bitwise_xor.reduce(b, axis=1).view(np.uint64) for w, b in bits.items()}  # to the sketch of the smaller size
            for i in range(0, len(own), 1 << 16):
                some = own[i : i + (1 << 16)]
                u, v = folded[wide][np.searchsorted(rows[wide], x[some])], folded[narrow][np.searchsorted(rows[narrow], y[some])]
                differ[some] = np.bitwise_count(u ^ v).sum(axis=1, dtype=np.int64)
        good = differ <= size[x] + size[y] - 2 * need
        return pa.RecordBatch.from_arrays([pa.array(ids[x[good]]), pa.array(ids[y[good]])], names=["x", "y"])

    return work


def _verifier(t: float, links: bool) -> Callable[[pa.Table, np.ndarray], pa.RecordBatch]:
    """The similar pairs, as pairs of the earliest documents (a) of both sets, or as links and stars; b: the documents of a set.

    links: (0, content, links) for each content, partial sums; (1, u, v) with u < v: documents that are in one part.
    """

    def work(sets: pa.Table, pairs: np.ndarray) -> pa.RecordBatch:
        ids, first, docs, data, off, x, y = _distinct(sets, pairs)
        size, begin = np.diff(off) // SET_BYTES, off[:-1] // SET_BYTES
        wide = np.zeros((len(data) // SET_BYTES, 8), np.uint8)
        wide[:, :SET_BYTES] = data.reshape(-1, SET_BYTES)
        token = np.unique(wide.view("<u8")[:, 0], return_inverse=True)[1].astype(np.int32)
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        mark, common = np.zeros(int(token.max(initial=0)) + 1, np.uint8), np.zeros(len(x), np.int64)
        start, length = runs(x)
        for s, k in zip(start.tolist(), length.tolist(), strict=True):
            own = token[begin[x[s]] : begin[x[s]] + size[x[s]]]
            mark[own] = 1
            while k:  # the partners of a set, some at a time
                n = max(1, int(np.searchsorted(np.cumsum(size[y[s : s + k]]), 4_000_000, "right")))
                other = y[s : s + min(n, k)]
                at = np.concatenate([[0], np.cumsum(size[other])[:-1]])
                common[s : s + len(other)] = np.add.reduceat(mark[token[ranges(begin[other], size[other])]], at, dtype=np.int64)
                s, k = s + len(other), k - len(other)
            mark[own] = 0
        jaccard = common / (size[x] + size[y] - common)
        good = np.round(jaccard, 9) >= t
        x, y, jaccard = x[good], y[good], jaccard[good]
        if not links:
            return pa.RecordBatch.from_arrays([pa.array(first[x]), pa.array(first[y]), pa.array(jaccard)], names=["x", "y", "jaccard"])
        n = np.bincount(x, weights=docs[y], minlength=len(ids)) + np.bincount(y, weights=docs[x], minlength=len(ids))
        order = np.argsort(first, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        low, u, v = np.arange(len(ids)), place[x], place[y]
        while True:
            least = np.minimum(low[u], low[v])
            new = low.copy()
            np.minimum.at(new, u, least)
            np.minimum.at(new, v, least)
            new = new[new]
            if (new == low).all():
                break
            low = new
        linked, leaf = np.flatnonzero(n), np.flatnonzero(first[order] != first[order][low])
        kind = np.repeat([0, 1], [len(linked), len(leaf)]).astype(np.int32)
        a = np.concatenate([ids[linked], first[order][low][leaf]])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(np.concatenate([n[linked].astype(np.int64), first[order][leaf]]))], names=["kind", "a", "b"])

    return work


def _tiles(pairs: DataFrame, content: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tile, x, y) of pairs of contents, and (id, tile, first, n_docs) of the contents that each tile needs; both are written."""
    ends = pairs.select(F.col("x").alias("id"), F.col("y").alias("o")).union(pairs.select("y", "x"))
    near = ends.groupBy("id").agg(F.min("o").alias("low"), F.count("*").alias("degree"))
    blocks = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("degree") / TILE_SETS, F.lit(1.0))))).cast("int")
    near = cut(near.select("id", F.least("id", "low").alias("low"), blocks.alias("blocks")))
    x, y = (near.select(F.col("id").alias(k), F.col("low").alias("low" + k), F.col("blocks").alias("blocks" + k)) for k in "xy")
    n = F.greatest("blocksx", "blocksy")
    p, q = (F.pmod(F.xxhash64(k), n) for k in "xy")
    tile = F.xxhash64(F.least("lowx", "lowy"), n, F.least(p, q), F.greatest(p, q))
    tiled = cut(pairs.join(x, "x").join(y, "y").select(tile.alias("tile"), "x", "y"))
    wanted = tiled.select("tile", F.col("x").alias("id")).union(tiled.select("tile", "y")).distinct()
    return tiled, cut(wanted.join(content.select("id", "first", "n_docs"), "id"))


def _sent(sets: DataFrame, wanted: DataFrame, tiled: DataFrame, a: str, b: str, size: float) -> DataFrame:
    """The sets (id, first, data) in each tile that wants them, and its pairs: partitions of whole tiles, sorted by tile.

    size: bytes of a set.
    """
    k = wanted.count()
    sent = sets.join(F.broadcast(wanted) if k <= BROADCAST_ROWS else wanted, ["id", "first"])
    none = F.lit(None).cast("bigint")
    rows = sent.select("tile", F.col("id").alias("x"), none.alias("y"), F.col(a).alias("a"), F.col(b).alias("b"), "data")
    rows = rows.union(tiled.select("tile", "x", "y", none, none, F.lit(None).cast("binary")))
    parts = max(partitions(sets.sparkSession), int(k * size) // PART_BYTES)
    return rows.repartition(parts, "tile").sortWithinPartitions("tile")


@dataclass(frozen=True)
class _Found:
    """members (doc_id, id, other): the content of each document; content (id, other, first, n_docs): its earliest document and
    their number; rows: what _verifier() gives."""

    members: DataFrame
    content: DataFrame
    rows: DataFrame


def _found(docs: DataFrame, links: bool, threshold: float, n: int, frequent: float, very_frequent: float, least_frequent: int, frequent_word: float) -> _Found:
    if not 0.4 <= threshold <= 1:
        raise ValueError("the groups of frequent tokens are laid out for thresholds from 0.4 to 1")
    spark = docs.sparkSession
    stats = cut(_statistics(docs, n, frequent, frequent_word))
    members = cut(stats.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("id"), "other", "size").distinct())
    total, tokens = members.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    often = stats.where("kind = 1").groupBy("a").agg(F.sum("b").alias("b")).where(F.col("b") >= least_frequent).orderBy(F.desc("b"), "a").limit(MOST_FREQUENT).toArrow()
    table, count = (often.column(c).to_numpy() for c in ("a", "b"))
    order = np.argsort(table.view(np.uint64))
    table, count = table.view(np.uint64)[order], count[order]
    occurring = stats.where("kind > 1").groupBy("kind", "a").agg(F.sum("b").alias("b"))
    spoken = max(1, sum(r.b for r in occurring.where("kind = 3").collect()))
    # the share bounds the number of words that can have it
    common = occurring.where((F.col("kind") == 2) & (F.col("b") >= frequent_word * spoken)).toArrow()
    words = WordLevels(common.column("a").to_numpy().view(np.uint64), common.column("b").to_numpy() / spoken, frequent_word)
    content = cut(members.groupBy("id", "other").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_docs")))

    met = cut(_candidates(docs, n, threshold, table, count, words, very_frequent * total, tokens))
    mean = tokens / max(total, 1)
    tiled, wanted = _tiles(met, content)
    sketches = stats.where("kind = 0").select(F.col("b").alias("id"), F.col("a").alias("first"), "size", F.col("sketch").alias("data"))
    met = cut(_sent(sketches, wanted, tiled, "size", "n_docs", mean / 4).mapInArrow(_by_tile(_alike(threshold)), "x bigint, y bigint"))

    tiled, wanted = _tiles(met, content)
    maybe = spark.sparkContext.broadcast(bloom(wanted.select("first").distinct(), "first"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(maybe.value.test(batch.column(0).to_numpy().view(np.uint64))))
            for a, b in chunks(batch.column(1)):
                ids = Sets(batch.column(1)[a:b], n).id
                token, bound = verified_sets(batch.column(1)[a:b], n)
                token = token.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES]
                packed = [token[bound[i] : bound[i + 1]].tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(ids.view(np.int64)), pa.array(packed, pa.binary())], names=["first", "id", "data"])

    made = _texts(docs).mapInArrow(sets_of, "first bigint, id bigint, data binary")
    rows = _sent(made, wanted, tiled, "first", "n_docs", SET_BYTES * mean)
    schema = "kind int, a bigint, b bigint" if links else "x bigint, y bigint, jaccard double"
    return _Found(members, content, rows.mapInArrow(_by_tile(_verifier(threshold, links)), schema))


def similar_pairs(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, frequent: float = FREQUENT, very_frequent: float = VERY_FREQUENT, least_frequent: int = LEAST_FREQUENT, frequent_word: float = FREQUENT_WORD) -> DataFrame:
    """(doc_a, doc_b, jaccard) with doc_a < doc_b: documents whose n-gram sets are similar.

    Documents with equal sets are one content, known by its earliest doc_id.  The rows are every pair of contents
    with similarity >= threshold, as their earliest documents, and one row (earliest, copy, 1.0) for each other
    document of a content: the similarity of any pair follows from these, and copies add no more rows than there are.

    Contents are told apart by 128 bits of hash, and sets are compared by 48-bit hashes of their tokens: in
    one of 10^9 pairs of sets of 500 tokens, two different ones count as the same.
    Rows without doc_id or text, and texts without words, pair with nothing.  doc_id is an integer, or a string of one;
    any other string is an error of the cast.  A text of fewer than n words is the set of the
    one token of all its words; long texts are sets of all their tokens.  A repeated row adds nothing.  Rows that share a doc_id
    but not the text are contents of their own; they never give a pair of a doc_id with itself.
    Columns beyond doc_id and text are not read.  An empty table gives an empty result.
    """
    found = _found(docs, False, threshold, n, frequent, very_frequent, least_frequent, frequent_word)
    near = found.rows.where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    copies = found.members.join(found.content, ["id", "other"]).where("doc_id <> first").select(F.col("first").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return near.union(copies).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def linked(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, frequent: float = FREQUENT, very_frequent: float = VERY_FREQUENT, least_frequent: int = LEAST_FREQUENT, frequent_word: float = FREQUENT_WORD) -> DataFrame:
    """(doc_id, class_id, n_links): one row for each document.

    n_links: how many other documents are similar to it, its copies among them.  class_id: the least doc_id of the part of the graph of
    similar documents that it is in; a document without links, or without words or text, is a class of its own.

    What similar_pairs() says of ids, short texts, repeated rows and columns holds here too.  Of rows that share a doc_id but not the
    text, each text has its links, n_links is their sum, and the class has them all.
    """
    found = _found(docs, True, threshold, n, frequent, very_frequent, least_frequent, frequent_word)
    rows = cut(found.rows)
    links = rows.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
    content = found.content.join(links, "id", "left")
    # a content of many documents is a hot key of this join, which adaptive execution splits
    own = cut(found.members.join(content, ["id", "other"]).select("doc_id", "first", (F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))).alias("n")))
    edges = rows.where("kind = 1").select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b")).union(own.where("doc_id <> first").select("first", "doc_id"))
    sums = own.groupBy("doc_id").agg(F.sum("n").alias("n_links"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    out = ids.join(sums, "doc_id", "left").join(groups(edges), "doc_id", "left")
    return out.select("doc_id", F.coalesce("first", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def groups(pairs: DataFrame) -> DataFrame:
    """(doc_id, first): the earliest document of each connected group, for every other member, by alternating stars."""
    edges = cut(pairs.select(F.least("doc_a", "doc_b").alias("u"), F.greatest("doc_a", "doc_b").alias("v")).where("u < v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour is linked to the least of the neighbourhood
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = edges.join(low, "u").select("low", "v").where("low < v").distinct()
        # small star: every neighbour that is not larger is linked to the least of them
        down = large.select(F.col("v").alias("u"), F.col("low").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("low"))
        small = down.join(least, "u")
        edges = cut(small.select(F.col("low").alias("u"), "v").where("u < v").union(least.select(F.col("low").alias("u"), F.col("u").alias("v"))).distinct())
        h = F.xxhash64("u", "v")
        now = edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()
        if now == before:  # the same edges as in the round before
            return edges.select(F.col("v").alias("doc_id"), F.col("u").alias("first"))
        before = now


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """The documents, all columns kept, without those that have an earlier document in their group of similar ones.

    Groups are the connected parts of similar_pairs(); rows that share a doc_id share its fate; rows without doc_id stay.
    """
    found = _found(docs, True, threshold, n, FREQUENT, VERY_FREQUENT, LEAST_FREQUENT, FREQUENT_WORD)
    stars = found.rows.where("kind = 1").select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))
    copies = found.members.join(found.content, ["id", "other"]).where("doc_id <> first").select("first", "doc_id")
    later = groups(stars.union(copies)).select(F.col("doc_id").alias("later"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # so that no name clashes
    kept = rows.join(later, F.col("row.doc_id").cast("long") == F.col("later"), "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and the number of links of every document of the table; see linked()."""
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))
