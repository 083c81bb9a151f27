"""Telephony audio: companded and ADPCM clips to resampled PCM.

mu-law and A-law bytes are expanded by tables of 256 samples.  IMA ADPCM (the layout of WAV files: blocks of a 4-byte header, first
sample and step index, and then two samples a byte, low half first) is decoded one half byte at a time over all blocks
of all clips at once: state and difference come from tables.  The samples are resampled by a polyphase windowed
sinc, all clips of a chunk in one pass with silence between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import mapper
from ._text import chunks, flat, ranges

RATE_IN, RATE_OUT = 8000, 16000
BLOCK = 256
HALF = 8  # taps on either side
CHUNK_BYTES = 1 << 20

MULAW, ALAW, ADPCM = "mulaw", "alaw", "ima_adpcm"


def _mulaw() -> np.ndarray:
    b = ~np.arange(256) & 0xFF
    size = (((b & 0x0F) << 3) + 0x84 << ((b & 0x70) >> 4)) - 0x84
    return np.where(b & 0x80, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    b = np.arange(256) ^ 0x55
    part, exponent = (b & 0x0F) << 4, (b & 0x70) >> 4
    size = np.where(exponent == 0, part + 8, (part + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(b & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: _mulaw(), ALAW: _alaw()}

STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767]
)
_nibble, _step = np.arange(16), STEPS[:, None]
_size = (_step >> 3) + np.where(_nibble & 4, _step, 0) + np.where(_nibble & 2, _step >> 1, 0) + np.where(_nibble & 1, _step >> 2, 0)
_DIFFERENCE = np.where(_nibble & 8, -_size, _size).astype(np.int32).ravel()
_NEXT = (np.clip(np.arange(89)[:, None] + np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2), 0, 88) * 16).astype(np.int32).ravel()


def adpcm_samples(n: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """How many samples clips of n bytes hold; a last block of fewer than 4 bytes holds none."""
    rest = n % block
    return n // block * (2 * (block - 4) + 1) + np.where(rest >= 4, 2 * (rest - 4) + 1, 0)


def decode_adpcm(data: np.ndarray, off: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Samples of all clips, one after the other; clip i is data[off[i]:off[i + 1]]."""
    n = np.diff(off)
    blocks = n // block + (n % block >= 4)
    clip = np.repeat(np.arange(len(n)), blocks)
    begin = off[:-1][clip] + ranges(np.zeros(len(n), np.int64), blocks) * block
    size = np.minimum(block, off[1:][clip] - begin)
    if not len(clip):
        return np.zeros(0, np.int16)
    padded = np.concatenate([data, np.zeros(block, np.uint8)])
    matrix = np.ascontiguousarray(padded[begin[None, :] + np.arange(block)[:, None]])  # one row for each byte of the blocks
    value = (matrix[0].astype(np.int32) | (matrix[1].astype(np.int8).astype(np.int32) << 8)).astype(np.int32)
    state = np.minimum(matrix[2], 88).astype(np.int32) * 16
    out = np.empty((2 * (block - 4) + 1, len(clip)), np.int16)
    out[0] = value
    for k in range(4, block):
        for half, nibble in ((0, matrix[k] & 15), (1, matrix[k] >> 4)):
            at = state + nibble
            value = np.clip(value + _DIFFERENCE[at], -32768, 32767)
            state = _NEXT[at]
            out[2 * (k - 4) + 1 + half] = value
    count = 2 * (size - 4) + 1
    full = np.ascontiguousarray(out.T).ravel()
    return full[ranges(np.arange(len(clip)) * out.shape[0], count)]


def _taps(up: int, down: int) -> np.ndarray:
    """taps[phase, k]: weight of the sample k - HALF + 1 places from the one at or before the output."""
    cut = min(1.0, up / down)
    f = np.arange(up)[:, None] / up
    x = f - (np.arange(2 * HALF) - HALF + 1)
    window = np.cos(np.pi * np.clip(x / (HALF + 1), -1, 1) / 2) ** 2
    t = cut * np.sinc(cut * x) * window
    return (t / t.sum(axis=1, keepdims=True)).astype(np.float32)


def resampled_sizes(n: np.ndarray, up: int, down: int) -> np.ndarray:
    return -(-n * up // down)


def resample(samples: np.ndarray, sizes: np.ndarray, rate_in: int = RATE_IN, rate_out: int = RATE_OUT) -> tuple[np.ndarray, np.ndarray]:
    """(samples, sizes) of clips at another rate; silence is assumed before and after each clip."""
    g = gcd(rate_in, rate_out)
    up, down = rate_out // g, rate_in // g
    if up == down:
        return samples, sizes
    taps = _taps(up, down)
    start = np.cumsum(sizes + 2 * HALF) - sizes - HALF
    wide = np.zeros(int((sizes + 2 * HALF).sum()) + 1, np.float32)
    wide[ranges(start, sizes)] = samples
    made = resampled_sizes(sizes, up, down)
    k = ranges(np.zeros(len(sizes), np.int64), made) * down
    phase, at = k % up, np.repeat(start, made) + k // up
    out = np.empty(len(k), np.int16)
    for p in range(up):
        own = np.flatnonzero(phase == p) if up > 1 else slice(None)
        some = np.flatnonzero(np.abs(taps[p]) > 1e-6)
        if len(some) == 1:
            y = wide[at[own] + some[0] - HALF + 1]
        else:
            # y[i] = sum of taps[p, j] * wide[i + j - HALF + 1]
            y = np.convolve(wide, taps[p][::-1])[HALF : HALF + len(wide)][at[own]]
        out[own] = np.clip(np.rint(y), -32768, 32767)
    return out, made


def decoded(clips: DataFrame, keep: tuple[str, ...], rate_in: int = RATE_IN, rate_out: int = RATE_OUT, block: int = BLOCK) -> DataFrame:
    """The columns `keep` of `clips`, codec, rate, n_samples and pcm (16 bits, little endian) from its columns codec and audio.

    A null clip has null pcm and n_samples, as has a clip of a codec other than mulaw, alaw and ima_adpcm; an empty clip has
    empty pcm.  A broken last ADPCM block gives the samples it has; a step index beyond 88 counts as 88.  Rows keep
    their number and may repeat.  A clip of 2 GiB of PCM or more, which no row can hold, is an error.  Columns beyond `keep`, codec and audio are not read.
    """

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codec, audio = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        for a, b in chunks(audio, CHUNK_BYTES):
            data, off = flat(audio[a:b])
            kind = np.array([c if c in TABLES or c == ADPCM else "" for c in codec[a:b].to_pylist()])
            n = np.diff(off)
            count = np.where(kind == ADPCM, adpcm_samples(n, block), np.where(kind == "", 0, n))
            start = np.cumsum(count) - count
            samples = np.empty(int(count.sum()), np.int16)
            for name, table in TABLES.items():
                own = np.flatnonzero(kind == name)
                samples[ranges(start[own], count[own])] = table[data[ranges(off[own], n[own])]]
            own = np.flatnonzero(kind == ADPCM)
            samples[ranges(start[own], count[own])] = decode_adpcm(data[ranges(off[own], n[own])], np.concatenate([[0], np.cumsum(n[own])]), block)
            pcm, size = resample(samples, count, rate_in, rate_out)
            none = np.asarray(audio[a:b].is_null()) | (kind == "")
            ends = np.concatenate([[0], np.cumsum(2 * size)])
            if ends[-1] >= 1 << 31:
                raise ValueError("a clip of 2 GiB of PCM or more doesn't fit into a row: cut it first")
            ends = ends.astype(np.int32)
            valid = pa.py_buffer(np.packbits(~none, bitorder="little").tobytes())
            binary = pa.Array.from_buffers(pa.binary(), b - a, [valid, pa.py_buffer(ends), pa.py_buffer(pcm.astype("<i2", copy=False))])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i)[a:b] for i in range(len(keep))), codec[a:b], pa.array(np.full(b - a, rate_out, np.int32)), pa.array(size.astype(np.int64), mask=none), binary], names=[*keep, "codec", "rate", "n_samples", "pcm"]
            )

    rows = clips.select(*[F.col(f"`{c}`") for c in keep], F.col("codec").cast("string").alias("_codec"), F.col("audio").cast("binary").alias("_audio"))
    schema = ", ".join(f"`{c}` {clips.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(mapper(of), f"{schema}, codec string, rate int, n_samples bigint, pcm binary")


def op1_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There is no table of audio: the bytes of every document serve as one clip.  Each clip has one codec, by its doc_id modulo 3."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    codec = F.element_at(F.array(*[F.lit(c) for c in (MULAW, ALAW, ADPCM)]), (F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)) + 1).cast("int"))
    return decoded(docs.select("doc_id", codec.alias("codec"), F.col("text").cast("binary").alias("audio")), ("doc_id",))
