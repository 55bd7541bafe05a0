"""Structured Streaming runs: an atom is a micro-batch, hooks run where a batch or the stream ends.

State stores use RocksDB, which the stateful processors need. A query's checkpoint folder makes it go on where it
stopped, each atom taking effect once if the hook is idempotent for its batch number.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Hook = Callable[[DataFrame, int], None]


def run_atoms(stream: DataFrame, on_atom: Hook, checkpoint: str, on_complete: Callable[[], None] | None = None, name: str | None = None) -> StreamingQuery:
    """Runs a stream to its present end: on_atom(rows, number) for each atom in order, then on_complete."""
    writer = stream.writeStream.foreachBatch(on_atom).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.queryName(name) if name else writer).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    if on_complete:
        on_complete()
    return query


class Runtime:
    """The queries of a session that are stepped together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.queries = spark, []
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def launch(self, stream: DataFrame, on_atom: Hook, checkpoint: str, seconds: float = 0.1) -> StreamingQuery:
        """Starts a query that looks for new atoms again and again."""
        query = stream.writeStream.foreachBatch(on_atom).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
        self.queries.append(query)
        return query

    def can_step(self) -> bool:
        """Whether some query is active and has work."""
        return any(q.isActive and (q.status["isDataAvailable"] or q.status["isTriggerActive"]) for q in self.queries)

    def step(self, seconds: float = 60.0) -> bool:
        """Waits until some query has handled one more atom; False if all were up to date already, or nothing came in that time."""
        seen = [q.lastProgress["batchId"] if q.lastProgress else -1 for q in self.queries]
        end = time.time() + seconds
        while time.time() < end:
            for q, before in zip(self.queries, seen, strict=True):
                if any(p["batchId"] > before and p["numInputRows"] for p in q.recentProgress):
                    return True
            if not self.can_step() and all(q.lastProgress or not q.isActive for q in self.queries):
                return False
            time.sleep(0.02)
        return False

    def step_until_complete(self) -> None:
        """Waits until every query has handled all that its source has now."""
        for q in self.queries:
            q.processAllAvailable()

    def step_for(self, seconds: float) -> None:
        """Lets the queries run for a time."""
        end = time.time() + seconds
        for q in self.queries:
            q.awaitTermination(max(0.001, end - time.time()))

    def shutdown(self) -> None:
        for q in self.queries:
            q.stop()
        self.queries = []
