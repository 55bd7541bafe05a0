"""Sessions for tests, for one machine, and for a cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession

from atomflow.streaming.runtime import ROCKSDB


def test(threads: int = 2) -> SparkSession:
    """A small local session without a user interface, whose results don't depend on the machine."""
    return parallel(threads, **{"spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC"})


def parallel(threads: int, **settings: str) -> SparkSession:
    """A local session with so many threads and as many shuffle partitions."""
    return default(**{"spark.master": f"local[{threads}]", "spark.sql.shuffle.partitions": str(threads), **settings})


def default(**settings: str) -> SparkSession:
    """The session of the cluster that runs this, with the state store that stateful operators need."""
    builder = SparkSession.builder.appName("atomflow").config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
