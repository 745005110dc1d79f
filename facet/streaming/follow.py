"""Views kept up to date from a stream of appended rows: a Spark extra on top of maintained aggregates.

Each micro-batch is aggregated by itself and merged into the view's accumulators, so that its cost follows the batch and not the collection. With a folder, the accumulators are written there after each batch under its number: lineage doesn't grow,
a lost executor costs a reread, and a follower that starts again goes on from the last whole state, so that a batch which comes again is not counted twice. Without one, that holds only while the follower lives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from facet.optimizer.views import View


class Follower:
    def __init__(self, view: View, folder: str | None = None):
        if view.state is None:
            raise ValueError("build the view first")
        self.view, self.last, self.folder = view, -1, folder
        if folder is not None and (done := self._states()):
            self.last = max(done)
            self._adopt()

    def _states(self) -> list[int]:
        """Numbers of the batches whose state is whole."""
        spark = self.view.state.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath() for s in fs.listStatus(root)]
        return [int(p.getName()) for p in names if p.getName().isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def _adopt(self) -> None:
        """Reads the state of the last batch in place of the plan that made it."""
        old = self.view.state
        self.view._keep(old.sparkSession.read.schema(old.schema).parquet(f"{self.folder}/{self.last}"), self.view.epoch)
        old.unpersist()

    def batch(self, rows: DataFrame, number: int) -> None:
        if number <= self.last:
            return
        self.view.apply(rows, None, self.view.epoch)
        self.last = number
        if self.folder is not None:
            self.view.state.write.mode("overwrite").parquet(f"{self.folder}/{number}")
            self._adopt()

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """trigger: for DataStreamWriter.trigger, for instance availableNow=True or processingTime="5 seconds"."""
        writer = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
