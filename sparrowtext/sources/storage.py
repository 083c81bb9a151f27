"""Where tables are kept, and reading documents from frames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SearchError


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where that is unset, a local master gets a folder of its own machine; with any other master it is an error.
    """
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise SearchError("storage", "set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="sparrowtext-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and authority that the cluster resolves it to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def cut(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder, without the plan that made them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """The rows in as many partitions as there are cores at least: a file of one row group is one task otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def documents(df: DataFrame, doc_id: Column | str, fields: list[str], sequence: str | None = None) -> DataFrame:
    """(doc_id, fields, `sequence`): a document for each row, from one column a field; a null column is a field that is absent."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    pairs = F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(key.cast("string").alias("doc_id"), F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("fields"), *([sequence] if sequence else []))
