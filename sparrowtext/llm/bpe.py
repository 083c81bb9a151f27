"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For byte-level BPE the encoding of every prefix of a word ends in one particular token, and a token t can follow a
token s exactly when encoding the bytes of both gives (s, t).  So the last token of each prefix is
the longest vocabulary entry that ends there and is compatible with the last token of the prefix before it; the ids are
read off by following these back-pointers.  The entries that end at a position come from an automaton with suffix
links over the vocabulary.

All distinct words (pieces of the pretokenizer) of a chunk are treated at once, one byte position per step.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import mapper
from ._text import _BYTE, Segments, chunks, flat, member, mix, ranges, runs

VOCABULARY = "byte_bpe_50k.tiktoken"
TOKENIZERS = "/opt/tokenizers"

WORDS_KEPT = 400_000  # words whose ids a Python worker keeps; more words cost time, nothing else
_BITS = 17  # ids stay below 2**17
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a file of (base64 token, rank) lines, in the order of their ranks, which are 0, 1, 2, ..."""
    with open(path, "rb") as f:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError(f"ranks of {path} have gaps")
    return [t for _, t in ranked]


class Bpe:
    """A vocabulary ready for encoding; built once in each Python worker."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.length = np.array([len(t) for t in tokens], np.int64)
        ids = {t: i for i, t in enumerate(tokens)}
        if len(tokens) >= 1 << _BITS:
            raise ValueError("too many tokens")
        if missing := [b for b in range(256) if bytes([b]) not in ids]:
            raise ValueError(f"bytes without a token: {missing}")
        # the pair from which each token is merged; a single byte counts as its own parts
        self.left = np.arange(len(tokens))
        self.right = np.arange(len(tokens))
        for t, token in enumerate(tokens):
            if len(token) > 1:
                parts = _merge([ids[token[i : i + 1]] for i in range(len(token))], tokens, ids, t)
                if len(parts) == 2:
                    self.left[t], self.right[t] = parts
        own = np.flatnonzero(self.length > 1)
        own = own[self.left[own] != own]
        self.reachable = np.ones(len(tokens), bool)
        self.reachable[np.setdiff1d(np.flatnonzero(self.length > 1), own)] = False
        key = (self.left[own] << _BITS) | self.right[own]
        order = np.argsort(key)
        self.pair_key, self.pair_id = key[order], own[order]
        self._automaton(ids)
        self.cache_key = np.full(1 << 20, -1, np.int64)
        self.cache_ok = np.zeros(1 << 20, bool)
        # ids of words met before, by hash: filled up to WORDS_KEPT words, and then fixed
        self.kept_key, self.kept_n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.kept_at, self.kept_ids = np.zeros(0, np.int64), np.zeros(0, np.int32)
        off = np.concatenate([[0], np.cumsum(self.length)])
        self.flat, self.flat_off = np.frombuffer(b"".join(tokens), np.uint8), off

    def _automaton(self, ids: dict[bytes, int]) -> None:
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for token, i in ids.items():
            if not self.reachable[i]:
                continue
            at = 0
            for byte in token:
                at = children[at].setdefault(byte, len(children))
                if at == len(children):
                    children.append({})
                    ends.append(-1)
            ends[at] = i
        n = len(children)
        fail, order = [0] * n, list(children[0].values())
        for at in order:
            for byte, child in children[at].items():
                f = fail[at]
                while f and byte not in children[f]:
                    f = fail[f]
                fail[child] = children[f].get(byte, 0)
                order.append(child)
        # a node without children moves as its suffix does, so only inner nodes have a row
        inner = [i for i in range(n) if children[i]]
        row = [0] * n
        for k, i in enumerate(inner):
            row[i] = k
        go = np.zeros((len(inner), 256), np.int32)
        for byte, child in children[0].items():
            go[0, byte] = child
        longest, shorter = list(ends), [-1] * len(ids)
        longest[0] = -1
        for at in order:
            f = fail[at]
            if children[at]:
                go[row[at]] = go[row[f]]
                for byte, child in children[at].items():
                    go[row[at], byte] = child
            else:
                row[at] = row[f]
            if longest[at] < 0:
                longest[at] = longest[f]
            else:
                shorter[longest[at]] = longest[f]
        self.go, self.row = go, np.array(row, np.int32)
        self.longest, self.shorter = np.array(longest, np.int32), np.array(shorter, np.int32)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token merged from each (a, b); a large number where there is none."""
        key = (a << _BITS) | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_id[at], 1 << 40)

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether encoding the bytes of tokens a and b gives (a, b): no merge across the border comes in time.

        The tokens are taken apart, latest merge first; a merge of the parts beside the border prevents (a, b) if it
        ranks before the merge that would use up one of them.
        """
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), 1 << 39)
        while len(at):
            crossed = self._pair(a, b) < limit
            ok[at[crossed]] = False
            right, left = self.right[a], self.left[b]
            a_whole, b_whole = right == a, left == b
            take_a = ~a_whole & (b_whole | (a > b))
            take_b = ~a_whole & ~take_a | (a_whole & ~b_whole)
            new_limit = np.where(take_a, a, b + 1)
            go = ~crossed & (take_a | take_b)
            a, b = np.where(take_a, right, a)[go], np.where(take_b, left, b)[go]
            limit, at = new_limit[go], at[go]
        return ok

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << _BITS) | b
        slot = (key * 0x9E3779B1 >> 7) & (len(self.cache_key) - 1)
        miss = np.flatnonzero(self.cache_key[slot] != key)
        if len(miss):
            fresh, first = np.unique(key[miss], return_index=True)
            some = slot[miss][first]
            ok = self._compatible(fresh >> _BITS, fresh & ((1 << _BITS) - 1))
            self.cache_key[some], self.cache_ok[some] = fresh, ok
            # two fresh pairs may want one slot: these are read from the list
            out = self.cache_ok[slot]
            lost = miss[self.cache_key[slot[miss]] != key[miss]]
            if len(lost):
                out[lost] = ok[np.searchsorted(fresh, key[lost])]
            hit = np.ones(len(key), bool)
            hit[miss] = False
            stolen = np.flatnonzero(hit & (self.cache_key[slot] != key))
            if len(stolen):
                out[stolen] = self._compatible(key[stolen] >> _BITS, key[stolen] & ((1 << _BITS) - 1))
            return out
        return self.cache_ok[slot]

    def encode_words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each) for the byte ranges of some words."""
        length = end - start
        count = np.zeros(len(start), np.int64)
        ids_of: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        order = np.argsort(length, kind="stable")
        edges = np.flatnonzero(np.diff(length[order], prepend=-1))
        for k, lo in enumerate(edges):
            hi = edges[k + 1] if k + 1 < len(edges) else len(order)
            n = int(length[order[lo]])
            for part in range(lo, hi, max(1, 4_000_000 // max(n, 1))):
                which = order[part : min(hi, part + max(1, 4_000_000 // max(n, 1)))]
                if n:
                    last = self._prefixes(data, start[which], n)
                    ids_of.append((which, *self._back(last, n)))
        for which, c, _ in ids_of:
            count[which] = c
        out = np.zeros(int(count.sum()), np.int32)
        first = np.cumsum(count) - count
        for which, c, ids in ids_of:
            out[ranges(first[which], c)] = ids
        return out, count

    def _prefixes(self, data: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
        """last[i, w]: the last token of the encoding of the first i + 1 bytes of word w."""
        w = len(start)
        last = np.empty((n, w), np.int32)
        state = np.zeros(w, np.int32)
        every = np.arange(w)
        for i in range(n):
            state = self.go[self.row[state], data[start + i]]
            token = self.longest[state]
            at, begin = every, i + 1 - self.length[token]
            while True:
                inner = begin > 0
                good = ~inner
                if inner.any():
                    k = np.flatnonzero(inner)
                    good[k] = self.compatible(last[begin[k] - 1, at[k]], token[k])
                last[i, at[good]] = token[good]
                bad = ~good
                if not bad.any():
                    break
                at, token = at[bad], self.shorter[token[bad]]
                if (token < 0).any():
                    raise ValueError("no token can end here: the vocabulary isn't one of byte pairs")
                begin = i + 1 - self.length[token]
        return last

    def _back(self, last: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        w = last.shape[1]
        place, every = np.full(w, n), np.arange(w)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.zeros(w, np.int64)
        while len(every):
            token = last[place - 1, every]
            found.append((every, token))
            count[every] += 1
            place = place - self.length[token]
            every, place = every[place > 0], place[place > 0]
        out = np.empty(int(count.sum()), np.int32)
        after = np.cumsum(count)
        for k, (which, token) in enumerate(found):
            out[after[which] - 1 - k] = token
        return count, out

    def encode(self, texts: pa.Array, raw: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 offsets).  raw: each text is one word, as it is."""
        data, off = flat(texts)
        start = off[:-1] if raw else pieces(texts, data, off)
        if raw:
            ids, count = self.encode_words(data, start, off[1:])
            return ids, np.concatenate([[0], np.cumsum(count)])
        end = np.append(start[1:], len(data)) if len(start) else start
        key = mix(Segments(_BYTE[data])(start, end) + (end - start).astype(np.uint64))
        order = np.argsort(key, kind="stable")
        first, n = runs(key[order])
        of = np.empty(len(key), np.int64)
        of[order] = np.repeat(np.arange(len(first)), n)
        own = order[first]
        ids, at, count = self._known(key[own], data, start[own], end[own])
        c = count[of]
        out = ids[ranges(at[of], c)]
        total = np.concatenate([[0], np.cumsum(c)])
        return out, total[np.searchsorted(start, off)]

    def _known(self, key: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, place of the first id of each word, number of ids) of distinct words, by ascending hash."""
        where = member(key, self.kept_key)
        new = np.flatnonzero(where < 0)
        ids, n = self.encode_words(data, start[new], end[new])
        at = np.cumsum(n) - n + len(self.kept_ids)
        place, count = self.kept_at[where] if len(self.kept_at) else np.zeros(len(key), np.int64), self.kept_n[where] if len(self.kept_n) else np.zeros(len(key), np.int64)
        place[new], count[new] = at, n
        everything = np.concatenate([self.kept_ids, ids])
        if len(new) and len(self.kept_key) < WORDS_KEPT:
            keys = np.concatenate([self.kept_key, key[new]])
            order = np.argsort(keys, kind="stable")
            self.kept_key = keys[order]
            self.kept_at, self.kept_n = np.concatenate([self.kept_at, at])[order], np.concatenate([self.kept_n, n])[order]
            self.kept_ids = everything
        return everything, place, count

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, n + 1 offsets) of some lists of ids."""
        length = self.length[ids]
        return self.flat[ranges(self.flat_off[ids], length)], np.concatenate([[0], np.cumsum(length)])[off]


def _merge(parts: list[int], tokens: list[bytes], ids: dict[bytes, int], below: int) -> list[int]:
    """Plain byte-pair merging with the tokens that rank before `below`; for building, not for texts."""
    while len(parts) > 1:
        rank, at = min((ids.get(tokens[a] + tokens[b], 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= below:
            break
        parts[at : at + 2] = [rank]
    return parts


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point for the pretokenizer: white space, letter, number or other."""
    out = np.full(0x110000, _OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = _LETTER
        elif kind == "N":
            out[cp] = _NUMBER
    for cp in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[cp] = _SPACE
    return out


def pieces(texts: pa.Array, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte offsets at which the pieces of the pretokenizer start.

    A piece is one of 's 't 're 've 'm 'll 'd, or a run of letters, of numbers or of other characters with at most one space
    before it, or white space; white space before something else leaves its last character to it, if that is
    a space, or else as a piece of its own.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # bytes that begin a character
    size = np.diff(np.append(lead, len(data)))
    cp = data[lead].astype(np.int32)
    for k, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        at = np.flatnonzero(size == k)
        if len(at):
            v = cp[at] & mask
            for j in range(1, k):
                v = (v << 6) | (data[lead[at] + j] & 0x3F)
            cp[at] = v
    kind = _classes()[cp]
    n = len(cp)
    head = np.zeros(n + 1, bool)  # the first character of a text
    head[np.searchsorted(lead, off)] = True
    blank = cp == 0x20
    starts = np.zeros(n, bool)
    starts[0] = True
    starts[1:] = kind[1:] != kind[:-1]
    starts |= head[:-1]
    # white space before something else: its last character stands alone or, as a space, joins what follows
    space = kind == _SPACE
    last = space.copy()
    last[:-1] &= ~space[1:] & ~head[1:-1]
    last[-1] = False
    starts[last] = True
    joined = np.flatnonzero(last & blank) + 1
    starts[joined] = False
    for i in np.flatnonzero((cp == 0x27) & starts).tolist():
        if i + 1 < n and not head[i + 1] and kind[i + 1] == _LETTER:
            for tail in ("s", "t", "re", "ve", "m", "ll", "d"):
                k = len(tail)
                if i + k < n and all(cp[i + 1 + j] == ord(c) and not head[i + 1 + j] for j, c in enumerate(tail)):
                    starts[i + 1] = False
                    if i + 1 + k < n and not space[i + 1 + k]:
                        starts[i + 1 + k] = True
                    break
    return lead[starts]


_BUILT: dict[int, Bpe] = {}


def built(tokens: list[bytes]) -> Bpe:
    """The encoder of a vocabulary, kept for the life of the Python worker."""
    key = hash(tuple(tokens))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Bpe(tokens)
    return _BUILT[key]


def _path(name: str, folder: str = TOKENIZERS) -> str:
    return f"{folder}/{name}"


def default_vocabulary() -> str:
    return _path(VOCABULARY)


def list_array(ids: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)))


def encoded(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns `keep`, n_tokens, and ids: the token ids of `text`; and round_trip: whether the ids decode to it.

    A null text has null ids, null n_tokens and null round_trip; an empty text has none and n_tokens 0.  Special tokens in a
    text are ordinary text.  Rows keep their number, repeated or not.  Columns beyond `keep` are not read.
    `vocabulary` is a file of base64 tokens with ranks, read on the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe = built(shared.value)
        texts = batch.column(batch.num_columns - 1)
        for a, b in chunks(texts):
            some = texts[a:b]
            ids, off = bpe.encode(some)
            data, at = flat(some)
            back, back_at = bpe.decode(ids, off)
            same = np.array_equal(data, back) and np.array_equal(at, back_at)
            trip = [True] * len(some) if same else [data[at[i] : at[i + 1]].tobytes() == back[back_at[i] : back_at[i + 1]].tobytes() for i in range(len(some))]
            none = np.asarray(some.is_null())
            lists, counts, trips = list_array(ids, off), np.diff(off).astype(np.int32), pa.array(trip, pa.bool_(), mask=none)
            if none.any():
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32), mask=np.append(none, False)), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i)[a:b] for i in range(len(keep))), pa.array(counts, mask=none), lists, trips], names=[*keep, "n_tokens", "ids", "round_trip"]
            )

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text_to_encode"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(mapper(of), f"{schema}, n_tokens int, ids array<int>, round_trip boolean")


def decoded(rows: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and text: what the column `ids` stands for.

    Null ids give a null text.  Ids outside the vocabulary are an error; bytes that are no UTF-8 become U+FFFD.
    """
    shared = rows.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe = built(shared.value)
        lists = batch.column(batch.num_columns - 1)
        off = np.concatenate([[0], np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])
        data, at = bpe.decode(lists.flatten().to_numpy(), off)
        raw = data.tobytes()
        none = lists.is_null().to_pylist()
        text = [None if none[i] else raw[at[i] : at[i + 1]].decode("utf-8", "replace") for i in range(len(lists))]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(text, pa.string())], names=[*keep, "text"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*[F.col(f"`{c}`") for c in keep], "ids").mapInArrow(mapper(of), f"{schema}, text string")


def op6_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = _path(VOCABULARY)) -> DataFrame:
    """The token ids of every document of the table, and whether they decode to its text; see encoded()."""
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary)
