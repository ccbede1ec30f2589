"""A mutable graph kept from a stream of adds and removes.

Each micro-batch is merged into a new version of the edge table, written beside the last and committed by the name of its
folder, so a batch that is run again after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.model import EDGES, OPERATIONS, Graph


class EdgeTable:
    """Versions of an edge table under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, n: int, directed: bool, policy: str = "list"):
        self.spark, self.folder, self.n, self.directed, self.policy = spark, folder, n, directed, policy

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in done)

    def graph(self, before: int | None = None) -> Graph:
        """The latest version, or the latest one of a batch before the given one."""
        versions = [v for v in self._versions() if before is None or v < before]
        edges = self.spark.read.schema(EDGES).parquet(f"{self.folder}/v={versions[-1]}") if versions else self.spark.createDataFrame([], EDGES)
        return Graph(edges, self.n, self.directed, self.policy)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        after = self.graph(before=batch_id).apply(batch.select("seq", "kind", "u", "v", "w"))
        after.edges.write.mode("overwrite").parquet(f"{self.folder}/v={batch_id}")


def stream_operations(spark: SparkSession, source: str, table: EdgeTable, checkpoint: str, max_files: int = 100) -> StreamingQuery:
    """Follows Parquet files of operations (seq, kind, u, v, w; seq grows from file to file) into the table; ends once what is
    there now has been taken in."""
    log = spark.readStream.schema(OPERATIONS).option("maxFilesPerTrigger", max_files).parquet(source)
    return log.writeStream.foreachBatch(table.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
