"""Vectorised text primitives shared by the operators: whole Arrow buffers in, numpy arrays out.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the
lower-cased text.  All hashes are 64-bit and depend on nothing but their bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2 << 20  # bytes of text that are in work at once
DOCS = 4095  # documents that are in work at once

_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if len(_POWERS.get("up", ())) < n:
        m = max(n, CHUNK + 1024)
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Segments:
    """Hashes of any stretch of a sequence of 64-bit values, in constant time each."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 2)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray, shift: int = 0) -> np.ndarray:
        """The stretch [start, end), read as if it began shift places after its base position."""
        return (self.sums[end] - self.sums[start]) * self.down[start - shift]


def flat(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, nulls as empty, and the n + 1 offsets into them."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if array.null_count:
        array = pc.fill_null(array, "" if not pa.types.is_binary(array.type) else b"")
    large = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(array: pa.Array, limit: int = CHUNK, docs: int = DOCS) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes (a longer text stands alone) and `docs` rows."""
    size = np.asarray(pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        stop = min(stop, at + docs, len(size))
        yield at, stop
        at = stop


def lowered(array: pa.Array) -> pa.Array:
    return pc.utf8_lower(array)


class Words:
    """The words of some texts: byte ranges, document of each, hash of each, all in text order."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        self.data, self.off = flat(lowered(texts) if lower else texts)
        data, off, n = self.data, self.off, len(texts)
        w = _WORD[data]
        before = np.zeros(len(w), bool)
        before[1:] = w[:-1]
        inner = off[:-1][off[:-1] < len(w)]
        before[inner] = False
        self.start = np.flatnonzero(w & ~before)
        after = np.zeros(len(w), bool)
        after[:-1] = w[1:]
        after[off[1:][off[1:] > 0] - 1] = False
        self.end = np.flatnonzero(w & ~after) + 1
        self.bound = np.searchsorted(self.start, off)  # words of document i: bound[i]:bound[i + 1]
        self.doc = np.repeat(np.arange(n), np.diff(self.bound))
        self.hash = mix(Segments(_BYTE[data])(self.start, self.end) + (self.end - self.start).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.start)


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of n words inside one document."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = words.hash[:m].copy()
    for k in range(1, n):
        h = mix(h) + words.hash[k : m + k] * np.uint64(2 * k + 1)
    at = np.flatnonzero(words.doc[:m] == words.doc[n - 1 :])
    return at, mix(h)[at]


HASH_BITS = 46
HASH = np.uint64((1 << HASH_BITS) - 1)
_TOKEN = np.uint64((1 << 52) - 1)


def ngram_sets(texts: pa.Array, n: int, level: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of every distinct n-gram of at most DOCS texts, ascending.

    A token is a 46-bit hash below 6 bits that sum up `level` of its words (by their hashes), 63 at most: given the
    frequencies of words, rare combinations come first.  A text of 1 to n - 1 words has the one token of all its
    words; a text without words has none.
    """
    words = Words(texts)
    at, h = ngrams(words, n)
    h &= HASH
    each = np.zeros(len(words) + 1, np.int64)
    if level is not None:
        np.cumsum(level(words.hash), out=each[1:])
        h |= np.minimum(each[at + n] - each[at], 63).astype(np.uint64) << np.uint64(HASH_BITS)
    key = (words.doc[at].astype(np.uint64) << np.uint64(52)) | h
    count = np.diff(words.bound)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        lo, hi = words.bound[short], words.bound[short + 1]
        whole = mix(Segments(words.hash)(lo, hi) + count[short].astype(np.uint64)) & HASH
        whole |= np.minimum(each[hi] - each[lo], 63).astype(np.uint64) << np.uint64(HASH_BITS)
        key = np.concatenate([key, (short.astype(np.uint64) << np.uint64(52)) | whole])
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(52)).astype(np.int64), key & _TOKEN


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return start, np.diff(np.append(start, len(sorted_values)))


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of start[i] .. start[i] + length[i] - 1."""
    total = int(length.sum())
    first = np.cumsum(length) - length
    return np.arange(total) - np.repeat(first - start, length)


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Position of each value in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return np.where(table[at] == values, at, -1)
