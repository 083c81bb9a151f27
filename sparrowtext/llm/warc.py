"""WARC records in seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames, each with the same number of uncompressed bytes or more of whole records,
and a skippable frame with the seek table at its end (the public seekable format: sizes of every frame, then their
number, a descriptor and a magic number).  A record is known by its bundle, frame and offset within the frame's content, so
that reading it takes the seek table and one frame.  Any Zstandard reader decompresses the whole bundle.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"

_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
SCHEMA = "bundle_id string, n_records int, n_frames int, raw_bytes bigint, bundle binary, records array<struct<page_id:bigint,record_id:string,frame:int,offset:bigint,length:bigint>>"


def record_id(url: bytes, body: bytes, page_id: int | None) -> str:
    """A name of the form of a version 8 UUID, from the hash of page id, address and content."""
    h = hashlib.blake2b(body, digest_size=16, key=hashlib.blake2b(b"%s %s" % (str(page_id).encode(), url), digest_size=32).digest()).hexdigest()
    return f"urn:uuid:{h[:8]}-{h[8:12]}-8{h[13:16]}-{'89ab'[int(h[16], 16) % 4]}{h[17:20]}-{h[20:]}"


def warc_record(name: str, url: bytes, body: bytes, date: str = DATE) -> bytes:
    """A resource record of WARC/1.1; line breaks in the address are percent-encoded."""
    url = url.replace(b"\r", b"%0D").replace(b"\n", b"%0A")
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <{name}>\r\nWARC-Date: {date}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\nWARC-Target-URI: "
    return head.encode() + url + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and content of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


class BundleWriter:
    """Records in; a bundle and the place of each record out."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.frame_bytes = frame_bytes
        self.press = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.done: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.at = self.raw = 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame, offset, length).  A record never spans frames; a frame ends once it is full."""
        place = (len(self.done), self.at, len(record))
        self.open.append(record)
        self.at += len(record)
        self.raw += len(record)
        if self.at >= self.frame_bytes:
            self._close()
        return place

    def _close(self) -> None:
        if self.open:
            packed = self.press.compress(b"".join(self.open))
            self.done.append(packed)
            self.sizes.append((len(packed), self.at))
            self.open, self.at = [], 0

    def finish(self) -> bytes:
        self._close()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        return b"".join(self.done) + struct.pack("<II", _SKIPPABLE, len(entries) + len(footer)) + entries + footer


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, read from the end of a bundle."""
    n, descriptor, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if descriptor & 0x80 else 8
    table = bundle[-9 - n * width : -9]
    sizes = [struct.unpack_from("<II", table, i * width) for i in range(n)]
    starts = np.concatenate([[0], np.cumsum([s for s, _ in sizes])]).astype(int).tolist()
    return [(a, *s) for a, s in zip(starts, sizes, strict=False)]


def read_frame(bundle: bytes, frame: int) -> bytes:
    at, packed, size = seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=size)


def bundles(pages: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL, date: str = DATE) -> DataFrame:
    """One row for each bundle: its bytes, and for each record page_id, record_id, frame, offset in the frame and length.

    Every partition of `pages` is bundled where it lies, in its order, without a shuffle; a bundle is named by its partition
    and number.  Every row gives a record, repeated ones too, which then share the record_id.  A null url or html counts as empty,
    a null page_id stays null; very long pages make long frames.  Columns beyond page_id, url and html are not read.
    An empty table gives no bundle.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        writer, places, n = BundleWriter(frame_bytes, level), [], 0

        def row() -> pa.RecordBatch:
            raw = writer.finish()
            cols = [[f"{part:06d}-{n:06d}"], [len(places)], [len(writer.sizes)], [writer.raw], [raw], [places]]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.struct([("page_id", pa.int64()), ("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bundle_id", "n_records", "n_frames", "raw_bytes", "bundle", "records"])

        for batch in batches:
            ids, urls, pages_ = batch.column(0), batch.column(1), batch.column(2)
            for i in range(batch.num_rows):
                page, url, body = ids[i].as_py(), urls[i].as_py() or b"", pages_[i].as_py() or b""
                name = record_id(url, body, page)
                frame, offset, length = writer.add(warc_record(name, url, body, date))
                places.append({"page_id": page, "record_id": name, "frame": frame, "offset": offset, "length": length})
                if writer.raw >= bundle_bytes:
                    yield row()
                    writer, places, n = BundleWriter(frame_bytes, level), [], n + 1
        if places:
            yield row()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").cast("binary").alias("url"), F.col("html").cast("string").cast("binary").alias("html"))
    return rows.mapInArrow(of, SCHEMA)


def record_index(made: DataFrame) -> DataFrame:
    """(page_id, record_id, bundle_id, frame, offset, length) of every record of bundles()."""
    return made.select("bundle_id", F.explode("records").alias("r")).select("r.page_id", "r.record_id", "bundle_id", "r.frame", "r.offset", "r.length")


def fetch(made: DataFrame, record_ids: Iterable[str]) -> DataFrame:
    """(record_id, page_id, record) of some records; each frame that holds one is decompressed once, and no other.

    A record that several rows of `made` hold is given as often; a name that none holds gives no row; no names or an empty table, none at all.
    """
    wanted = set(record_ids)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, bytes]] = []
            for raw, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                frames: dict[int, bytes] = {}
                for p in places:
                    if p["record_id"] in wanted:
                        if p["frame"] not in frames:
                            frames[p["frame"]] = read_frame(raw, p["frame"])
                        out.append((p["record_id"], p["page_id"], frames[p["frame"]][p["offset"] : p["offset"] + p["length"]]))
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["record_id", "page_id", "record"])

    hit = made.where(F.arrays_overlap(F.col("records.record_id"), F.array(*[F.lit(x) for x in sorted(wanted)]).cast("array<string>")))
    return hit.select("bundle", "records").mapInArrow(of, "record_id string, page_id bigint, record binary")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of pages as bundles; see bundles()."""
    return bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"))
