"""Counts of rows that came too late, for every batch of every stream."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from txnwatch.session import local_rows

SCHEMA = "query_id STRING, batch_id BIGINT, dropped BIGINT, event_time_watermark STRING"


class LateRows(StreamingQueryListener):
    """Adds a row per batch that dropped rows to a table in ``path``.

    A query's own progress forgets all but its last batches. A batch that is run again replaces
    its own row. State is updated after partial aggregation, so late rows of one key that a task
    of one batch has aggregated count once.

        late = LateRows(spark, path)
        spark.streams.addListener(late)
        ...
        late.wait(query)
        late.rows()
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._ended, self._more = spark, path, set(), threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        dropped = sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
        if dropped:
            row = (str(progress.id), progress.batchId, dropped, progress.eventTime.get("watermark"))
            folder = f"{self.path}/query={progress.id}/batch={progress.batchId}"
            local_rows(self.spark, [row], SCHEMA).coalesce(1).write.mode("overwrite").parquet(folder)

    def onQueryTerminated(self, event) -> None:
        with self._more:
            self._ended.add(str(event.runId))
            self._more.notify_all()

    def wait(self, query, seconds: float = 60) -> None:
        """Until all of an ended query's batches are counted; events arrive some time later."""
        query.awaitTermination()
        with self._more:
            if not self._more.wait_for(lambda: str(query.runId) in self._ended, seconds):
                raise TimeoutError("the query's end was not reported")

    def rows(self) -> DataFrame:
        """(query_id, batch_id, dropped, event_time_watermark) of all batches that dropped rows."""
        jvm = self.spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/query=*/batch=*/_SUCCESS")
        files = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not (files.globStatus(pattern) or []):
            return local_rows(self.spark, [], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/query=*/batch=*")
