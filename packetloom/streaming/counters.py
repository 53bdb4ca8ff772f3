"""Counters of running streams: aggregates that Spark observes in each batch, summed over batches.

A stream names what is counted with `observed`; the metrics come with each batch's progress report. `Counters` is a listener that keeps the report of each batch, by the query's id and the batch's number, so a batch that
is run again replaces what it reported before, and a query that is started again from its checkpoint goes on counting.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def observed(stream: DataFrame, name: str, counts: dict[str, Column]) -> DataFrame:
    """The stream, with these aggregates reported for each batch."""
    return stream.observe(name, *(c.alias(k) for k, c in counts.items()))


class Counters(StreamingQueryListener):
    """What was observed: whole numbers by observation, name, query and batch."""

    def __init__(self) -> None:
        self.found: dict[tuple[str, str, str, int], int] = {}
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for name, row in p.observedMetrics.items():
            for k, v in row.asDict().items():
                self.found[name, k, str(p.id), p.batchId] = int(v or 0)

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> bool:
        """Waits for the end of a query and of its reports."""
        query.awaitTermination()
        return self.ended.setdefault(str(query.runId), threading.Event()).wait(seconds)

    def totals(self, spark: SparkSession) -> DataFrame:
        """(observation, name, value): sums over all queries and batches; a row for each name."""
        rows = [(o, k, q, n, v) for (o, k, q, n), v in sorted(self.found.items())]
        return spark.createDataFrame(rows, "observation string, name string, query string, batch long, value long").groupBy("observation", "name").agg(F.sum("value").alias("value"))
