"""Spark helpers: lineage cuts, packed shuffles and size-bounded membership filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import cut, shared_folder
from ._text import mix

__all__ = ["Filter", "Packer", "bloom", "buckets", "by_bucket", "cut", "estimate", "mapper", "packed_schema", "partitions", "shared_folder", "unpack"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def estimate(df: DataFrame) -> int | None:
    """Bytes of the rows, as the optimizer sees them (files count as they are stored); None where it can't tell."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


def buckets(df: DataFrame, times: float, bucket: int = 48 << 20) -> int:
    """Buckets for packed arrays of `times` the size of the rows, each of about `bucket` bytes; spark.sql.shuffle.partitions at least."""
    return int(min(20_000, max(partitions(df.sparkSession), times * (estimate(df) or 0) // bucket)))


def by_bucket(df: DataFrame, n: int) -> DataFrame:
    """Rows of packed arrays, each sent to the partition that its column `bucket` names."""
    return df.repartitionById(n, F.col("bucket"))


class Packer:
    """Collects parallel numpy columns and gives rows (bucket, one binary per column)."""

    def __init__(self, n: int, names: list[str], limit: int = 48 << 20):
        self.n, self.names, self.limit, self.held, self.size = n, names, limit, [], 0

    def add(self, bucket: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(bucket):
            self.held.append((bucket.astype(np.int32), *columns))
            self.size += sum(x.nbytes for x in columns)
        if self.size > self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        bucket, *columns = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.n + 1))
        full = np.flatnonzero(np.diff(edges))
        out = [pa.array(full.astype(np.int32))]
        for c in columns:
            c = c[order]
            out.append(pa.array([c[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()))
        yield pa.RecordBatch.from_arrays(out, names=["bucket", *self.names])


def unpack(batches: Iterator[pa.RecordBatch], kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """All rows of a partition as one array per column."""
    held: dict[str, list[bytes]] = {k: [] for k in kinds}
    for b in batches:
        for k in kinds:
            held[k] += b.column(k).to_pylist()
    return {k: np.frombuffer(b"".join(held[k]), kind) for k, kind in kinds.items()}


def packed_schema(names: list[str]) -> str:
    return "bucket int, " + ", ".join(f"{n} binary" for n in names)


class Filter:
    """A Bloom filter over 64-bit integers; its size is fixed, whatever the number of members.

    False positives cost work, never rows: every use is followed by an exact join.
    """

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def test(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for at in _places(values, len(self.bits) * 8):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def _places(values: np.ndarray, m: int) -> list[np.ndarray]:
    a = mix(values.astype(np.uint64))
    b = mix(a) | np.uint64(1)
    return [(a + np.uint64(k) * b) % np.uint64(m) for k in range(3)]


def bloom(ids: DataFrame, column: str, most_log2_bits: int = 26) -> Filter:
    """The filter of an integer column, built in parallel and merged: about 12 bits an id, 2**most_log2_bits at most (8 MB)."""
    m = 1 << int(np.clip(np.ceil(np.log2(12 * max(ids.count(), 1))), 13, most_log2_bits))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(m, bool)
        seen = False
        for b in batches:
            v = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            seen |= len(v) > 0
            for at in _places(v.astype(np.int64).view(np.uint64), m):
                bits[at] = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(m // 8, np.uint8)
    for row in ids.select(F.col(column).cast("long").alias("id")).repartition(4, "id").mapInArrow(build, "bits binary").collect():
        total |= np.frombuffer(row.bits, np.uint8)
    return Filter(total)


def mapper(make: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one that treats a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from make(b)

    return run
