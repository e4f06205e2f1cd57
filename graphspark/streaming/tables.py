"""Tables that streams keep up: the newest row of each key, and findings written once.

``NewestTable`` merges on read. A batch appends what it brings, one row a key, under its number; a batch that comes again after a restart
overwrites its own part, and newest-by-order doesn't depend on the order of arrival, so no replay and no late event changes the result.
Every ``compact_every`` batches the table so far is written as a new base; a base counts once its commit is there, so a crash in between
leaves the older one in use. ``vacuum`` removes what no reader needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.gates import row_gates


class NewestTable:
    """A folder with the newest row of each key of a stream; ``order`` names the columns that say what is newer."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], order: list[str], schema: T.StructType, compact_every: int = 20):
        self.spark, self.folder, self.keys, self.order, self.schema, self.compact_every = spark, folder.rstrip("/"), keys, order, schema, compact_every

    def newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.names if c not in self.keys and c not in self.order]
        best = F.max(F.struct(*self.order, *rest)).alias("__m")
        return rows.groupBy(*self.keys).agg(best).select(*self.keys, "__m.*").select(*self.schema.names)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``; the same batch may come any number of times."""
        self.newest(batch.select(*self.schema.names)).write.mode("overwrite").parquet(f"{self.folder}/changes/batch={batch_id:010d}")
        if (batch_id + 1) % self.compact_every == 0:
            self.compact(batch_id)

    def compact(self, batch_id: int) -> None:
        """Writes all up to a batch as a base, and then its commit."""
        self.read(batch_id).write.mode("overwrite").parquet(f"{self.folder}/base/upto={batch_id:010d}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.folder}/commits/upto={batch_id:010d}")

    def _numbers(self, part: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if "=" in s.getPath().getName()) if fs.exists(path) else []

    def read(self, upto: int | None = None) -> DataFrame:
        """The table, as of a batch or as of now."""
        within = lambda n: upto is None or n <= upto
        base = max(filter(within, self._numbers("commits")), default=-1)
        parts = [f"{self.folder}/changes/batch={n:010d}" for n in self._numbers("changes") if n > base and within(n)]
        parts += [f"{self.folder}/base/upto={base:010d}"] if base >= 0 else []
        rows = self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)
        return self.newest(rows)

    def vacuum(self) -> None:
        """Removes changes that the newest base holds, and older bases. Not while an older version is read."""
        base = max(self._numbers("commits"), default=-1)
        for part, name in (("changes", "batch"), ("base", "upto"), ("commits", "upto")):
            for n in self._numbers(part):
                if n < base or part == "changes" and n == base:
                    path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}/{name}={n:010d}")
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def start(self, rows: DataFrame, checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
        """Keeps the table up from a stream whose rows hold ``schema``; trigger as in ``writeStream.trigger``."""
        return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(self.merge).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def latest_status_table(spark: SparkSession, folder: str, compact_every: int = 20) -> NewestTable:
    """Newest stage by repository of events (event_id, ts, repo_id, stage)."""
    return NewestTable(spark, folder, ["repo_id"], ["ts", "event_id"], T.StructType.fromDDL("repo_id long, ts timestamp, event_id long, stage string"), compact_every)


def counts_table(spark: SparkSession, folder: str, compact_every: int = 20) -> NewestTable:
    """Counts by window and status, where the newest batch's count stands."""
    return NewestTable(spark, folder, ["window_start", "status"], ["batch"], T.StructType.fromDDL("window_start timestamp, status string, batch long, n long"), compact_every)


def start_counts(counts: DataFrame, table: NewestTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes streaming counts (window_start, status, n) in update mode."""
    merge: Callable[[DataFrame, int], None] = lambda batch, batch_id: table.merge(batch.withColumn("batch", F.lit(batch_id).cast("long")), batch_id)
    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def start_findings(payloads: DataFrame, folder: str, checkpoint: str, gates: Callable[[DataFrame], DataFrame] = row_gates, **trigger) -> StreamingQuery:
    """Violations of streaming payload rows into Parquet files by check. The sink's log holds each batch once, so a restart neither loses nor doubles a finding; read the folder as a whole."""
    rows = gates(payloads)
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).partitionBy("check").outputMode("append").trigger(**(trigger or {"processingTime": "1 minute"})).start()


def read_findings(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(folder)
