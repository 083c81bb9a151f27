"""Token ids in Parquet: list columns with a chosen encoding, row groups of a chosen size, page indexes.

Each task writes one file for its partition, so nothing is shuffled.  A row group holds about ROW_GROUP_TOKENS ids
and is ordered by doc_id; pages are small and indexed.  A reader of doc_id, n_tokens or source touches only those columns; a
reader of some documents' tokens touches only the pages whose doc_id range holds them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import qualified
from ._spark import cut, shared_folder
from ._text import chunks
from .bpe import VOCABULARY, _path, built, list_array, read_ranks

ROW_GROUP_TOKENS = 1 << 20
PAGE_BYTES = 64 << 10
META = ("source", "lang")
MANIFEST = "doc_id bigint, n_tokens int, file string, row_group int, row int"


def _writer(sink: pa.NativeFile, schema: pa.Schema, encoding: str) -> pq.ParquetWriter:
    ids = "tokens.list.element"
    meta = [c for c in schema.names if c in META]
    how: dict = {"use_dictionary": [*meta, ids]} if encoding == "dictionary" else {"use_dictionary": meta}
    delta = {"doc_id": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"} | ({ids: "DELTA_BINARY_PACKED"} if encoding == "delta" else {})
    return pq.ParquetWriter(sink, schema, column_encoding=delta, compression={c: "NONE" if c == ids else "ZSTD" for c in [*(c for c in schema.names if c != "tokens"), ids]}, write_page_index=True, data_page_size=PAGE_BYTES, write_statistics=True, **how)


def write_tokens(docs: DataFrame, vocabulary: str, path: str, encoding: str = "delta", row_group_tokens: int = ROW_GROUP_TOKENS) -> DataFrame:
    """Writes doc_id, the columns META that `docs` has, n_tokens and tokens below `path`; gives (doc_id, n_tokens, file, row_group, row).

    encoding: delta or dictionary, of the ids.  A file gets a name of its own in each attempt of a task, and the result names the
    files of those that succeeded: a lost executor leaves at most files that nothing names.  The result is written once,
    so that reading it again doesn't tokenise again.

    A null text has null tokens and null n_tokens, an empty text no tokens; a row with a null doc_id keeps it and comes first in its row
    group; repeated rows are stored as often.  Columns beyond doc_id, text and META are not read.  An empty table gives no file.
    """
    if encoding not in ("delta", "dictionary"):
        raise ValueError(f"no such encoding: {encoding}")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))
    meta = [c for c in META if c in docs.columns]
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in meta), ("n_tokens", pa.int32()), ("tokens", pa.list_(pa.int32()))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = built(shared.value)
        file = f"part-{uuid.uuid4().hex}.parquet"
        fs, base = pafs.FileSystem.from_uri(path)
        writer, sink, held, size, group = None, None, [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal writer, sink, held, size, group
            if writer is None:
                fs.create_dir(base, recursive=True)
                sink = fs.open_output_stream(f"{base}/{file}")
                writer = _writer(sink, schema, encoding)
            table = pa.Table.from_batches(held, schema).sort_by([("doc_id", "ascending")]) if len(held) else None
            order = np.asarray(table.column("doc_id").is_null())
            if order.any():
                table = pa.concat_tables([table.filter(pa.array(order)), table.filter(pa.array(~order))])
            table = table.combine_chunks()
            writer.write_table(table, row_group_size=max(1, table.num_rows))
            n = table.num_rows
            out = pa.RecordBatch.from_arrays(
                [table.column("doc_id").combine_chunks(), table.column("n_tokens").combine_chunks(), pa.array([file] * n), pa.array(np.full(n, group, np.int32)), pa.array(np.arange(n, dtype=np.int32))],
                names=["doc_id", "n_tokens", "file", "row_group", "row"],
            )
            held, size, group = [], 0, group + 1
            return out

        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in chunks(texts):
                ids, off = bpe.encode(texts[a:b])
                none = np.asarray(texts[a:b].is_null())
                lists = list_array(ids, off)
                if none.any():
                    lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32), mask=np.append(none, False)), pa.array(ids))
                made = pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(batch.num_columns - 1)), pa.array(np.diff(off).astype(np.int32), mask=none), lists], schema=schema)
                at = 0
                while at < len(made):
                    end = min(len(made), max(at + 1, int(np.searchsorted(off, off[at] + row_group_tokens - size, "left"))))
                    held.append(made.slice(at, end - at))
                    size += int(off[end] - off[at])
                    at = end
                    if size >= row_group_tokens:
                        yield flush()
        if held:
            yield flush()
        if writer is not None:
            writer.close()
            sink.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in meta], F.col("text").cast("string").alias("_text_to_encode"))
    return cut(rows.mapInArrow(write, MANIFEST))


def read_tokens(spark: SparkSession, path: str, manifest: DataFrame, columns: Iterable[str] = ("doc_id", "tokens"), doc_ids: Iterable[int] | None = None) -> DataFrame:
    """Some columns of the stored rows, of all documents or of some: only the files that the manifest names, and those pages."""
    names = manifest.select("file").distinct() if doc_ids is None else manifest.where(F.col("doc_id").isin(list(doc_ids))).select("file").distinct()
    files = [f"{path}/{r.file}" for r in names.collect()]
    if not files:
        return spark.createDataFrame([], "doc_id bigint, n_tokens int, tokens array<int>").select(*[c for c in columns if c not in META])
    rows = spark.read.parquet(*files)
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(list(doc_ids)))
    return rows.select(*columns)


def op7_token_store(spark: SparkSession, sf_dir: str, vocabulary: str = _path(VOCABULARY)) -> DataFrame:
    """Where the tokens of each document are stored, below the shared folder."""
    return write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary, qualified(spark, f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"))
