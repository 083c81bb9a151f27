"""An index kept up to date from a stream of changes."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.analysis import Analyzer
from ..operators.index import SearchIndex
from ..sources.storage import new_folder


def apply_changes(index: SearchIndex, changes: DataFrame, sequence: str = "seq") -> SearchIndex:
    """The index after changes (op, doc_id, fields, `sequence`); op is add or delete, and the last one of a doc_id counts."""
    last = changes.withColumn("_n", F.expr(f"row_number() over (partition by doc_id order by `{sequence}` desc)")).where("_n = 1")
    return index.delete(last.where("op = 'delete'").select("doc_id")).add(last.where("op = 'add'").select("doc_id", "fields"))


class Maintainer:
    """Merges each micro-batch into a new version of the tables; readers of the version before are not disturbed.

    Versions are named by a table (batch, folder) below `path`, written after the version itself.  A batch that is tried again
    starts from the version before it, so that it counts once; and after a restart with the same `path` the last version that was named
    goes on, where the stream itself resumes by its checkpoint.
    """

    def __init__(self, index: SearchIndex, sequence: str = "seq", path: str | None = None):
        self.sequence, self.first = sequence, index
        self.spark = index.documents.sparkSession
        self.path = path or new_folder(self.spark, "versions")

    def versions(self) -> dict[int, str]:
        """The folder of each batch; of a batch that was merged twice, either, as they hold the same."""
        try:
            rows = self.spark.read.schema("batch bigint, folder string").json(f"{self.path}/named").collect()  # one row a batch
        except AnalysisException:  # no batch yet
            return {}
        return {r.batch: r.folder for r in rows}

    def before(self, batch: int | None = None) -> SearchIndex:
        """The index without the changes of `batch` and later ones; the latest if that is None."""
        known = {k: v for k, v in self.versions().items() if batch is None or k < batch}
        return SearchIndex.load(self.spark, known[max(known)], self.first.analyzer) if known else self.first

    @property
    def index(self) -> SearchIndex:
        return self.before()

    def merge(self, changes: DataFrame, batch: int) -> None:
        folder = f"{self.path}/{batch}-{uuid.uuid4().hex}"
        apply_changes(self.before(batch), changes, self.sequence).save(folder)
        row = self.spark.createDataFrame([(batch, folder)], "batch bigint, folder string")
        row.coalesce(1).write.mode("append").json(f"{self.path}/named")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).start()


def empty_index(changes: DataFrame, analyzer: Analyzer | None = None) -> SearchIndex:
    """An index without documents, in the session of `changes`."""
    spark = changes.sparkSession
    return SearchIndex.build(spark.createDataFrame([], "doc_id string, fields map<string,string>"), analyzer)
