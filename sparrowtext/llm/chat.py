"""Chat formatting by columnar byte assembly.

The turns of a conversation become one text: <|im_start|>role, the content, <|im_end|>.  The lengths of all segments of a
batch give cumulative offsets; scatter indices copy headers and contents into one preallocated
buffer, which becomes the Arrow column as it is.  No string is built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import mapper
from ._text import flat, ranges

START, MIDDLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
LEARN = "assistant"


def assemble(roles: pa.Array, contents: pa.Array, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets of conversations, start and end of each content within its conversation).

    turns: n + 1 offsets of the conversations into roles and contents.
    """
    (role, role_off), (text, text_off) = flat(roles), flat(contents)
    n = len(roles)
    fixed = [np.frombuffer(x, np.uint8) for x in (START, MIDDLE, END)]
    length = np.zeros((n, 5), np.int64)
    length[:, 0], length[:, 2], length[:, 4] = (len(x) for x in fixed)
    length[:, 1], length[:, 3] = np.diff(role_off), np.diff(text_off)
    start = (np.cumsum(length.ravel()) - length.ravel()).reshape(n, 5)
    out = np.empty(int(length.sum()), np.uint8)
    for k, piece in ((0, fixed[0]), (2, fixed[1]), (4, fixed[2])):
        out[start[:, k, None] + np.arange(len(piece))] = piece
    out[ranges(start[:, 1], length[:, 1])] = role
    out[ranges(start[:, 3], length[:, 3])] = text
    ends = np.append(start[:, 0], len(out))
    off = ends[turns]
    base = np.repeat(off[:-1], np.diff(turns))
    return out, off, start[:, 3] - base, start[:, 3] + length[:, 3] - base


def _neutral(text: Column) -> Column:
    """Control marks inside a content are broken up, so that a turn can't forge another."""
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def formatted(conversations: DataFrame, learn: str = LEARN) -> DataFrame:
    """(conv_id, n_turns, text, spans): each conversation in the order of its turns, and the byte ranges to learn from.

    spans: [start, end) in bytes of the contents of the role `learn`.  A null role or text counts as empty; null turns come
    first; turns of equal number are ordered by role, then text, and a repeated row is a turn of its own.  Rows without conv_id
    belong to no conversation and are left out.  Columns beyond conv_id, turn, role and text are not read.
    """
    rows = conversations.where("conv_id is not null").select(
        "conv_id",
        F.struct(
            F.col("turn").cast("long").alias("turn"), F.coalesce(_neutral(F.col("role").cast("string")), F.lit("")).alias("role"), F.coalesce(_neutral(F.col("text").cast("string")), F.lit("")).alias("text")
        ).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(1)
        turns = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        parts = lists.flatten()
        roles = parts.field("role")
        data, off, start, end = assemble(roles, parts.field("text"), turns)
        kind = pa.large_string() if len(data) >= 2**31 else pa.string()
        text = pa.Array.from_buffers(kind, batch.num_rows, [None, pa.py_buffer(off.astype(np.int64 if pa.types.is_large_string(kind) else np.int32)), pa.py_buffer(data)])
        own = np.array([r == learn for r in roles.to_pylist()], bool)
        conv = np.repeat(np.arange(batch.num_rows), np.diff(turns))
        edge = np.searchsorted(conv[own], np.arange(batch.num_rows + 1)).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(edge), pa.StructArray.from_arrays([pa.array(start[own]), pa.array(end[own])], names=["start", "end"]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(turns).astype(np.int32)), text, spans], names=["conv_id", "n_turns", "text", "spans"])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return whole.mapInArrow(mapper(of), f"conv_id {kind}, n_turns int, text string, spans array<struct<start:bigint,end:bigint>>")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
