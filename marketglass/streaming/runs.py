"""One row for each run of a stream: what it read, what was broken, and how it ended."""

from __future__ import annotations

import threading
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

RUN = "run_id string, name string, started timestamp, batches int, items long, broken long, error string"
METRICS = "items_of_run"


def counted(stream: DataFrame, broken: Column) -> DataFrame:
    """The stream, whose rows and broken rows are counted as they pass, without a second read."""
    return stream.observe(METRICS, F.count(F.lit(1)).alias("items"), F.count_if(F.coalesce(broken, F.lit(False))).alias("broken"))


class Runs(StreamingQueryListener):
    """Listens to a session's streams and appends a row (columns RUN) to a table when one ends."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.open: dict[str, list] = {}
        self.written: set[str] = set()
        self.ended = threading.Condition()

    def onQueryStarted(self, event) -> None:
        at = datetime.fromisoformat(event.timestamp.replace("Z", "+00:00")).replace(tzinfo=None)
        self.open[str(event.runId)] = [str(event.runId), event.name, at, 0, 0, 0, None]

    def onQueryProgress(self, event) -> None:
        row = self.open.get(str(event.progress.runId))
        found = event.progress.observedMetrics.get(METRICS)
        if row and found is not None:
            row[3] += 1
            row[4] += found["items"]
            row[5] += found["broken"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        row = self.open.pop(str(event.runId), None)
        if row:
            row[6] = event.exception.splitlines()[0] if event.exception else None
            self.spark.createDataFrame([tuple(row)], RUN).coalesce(1).write.mode("append").parquet(self.path)
            with self.ended:
                self.written.add(row[0])
                self.ended.notify_all()

    def wait(self, run_id: str, seconds: float = 30) -> bool:
        """Until that run's row is written, as listeners are told after the query has ended."""
        with self.ended:
            return self.ended.wait_for(lambda: run_id in self.written, seconds)

    def table(self) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(self.path)
