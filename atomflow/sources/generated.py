"""Unbounded and pushed sources, for Structured Streaming."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


class _AtomReader(SimpleDataSourceStreamReader):
    """One atom per read; the offset is the ordinal of the next atom. With per_second, an atom waits until those before it have taken their time."""

    def __init__(self, atom_of: Callable[[int], Iterable[tuple] | None], per_second: float | None = None):
        self.atom_of, self.per_second, self.free_at = atom_of, per_second, 0.0

    def initialOffset(self) -> dict:
        return {"atom": 0}

    def read(self, start: dict):
        if self.per_second and time.monotonic() < self.free_at:
            return iter(()), start
        rows = self.atom_of(start["atom"])
        if rows is None:
            return iter(()), start
        rows = [Row(*r) for r in rows]
        if self.per_second:
            self.free_at = time.monotonic() + len(rows) / self.per_second
        return iter(rows), {"atom": start["atom"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([Row(*r) for atom in range(start["atom"], end["atom"]) for r in self.atom_of(atom) or ()])


def generator(name: str, schema: str, atom_of: Callable[[int], Iterable[tuple] | None], per_second: float | None = None) -> type[DataSource]:
    """A streaming source of a user's generator: atom_of gives the rows of the n-th atom, or None when there is none yet.

    Register the class with spark.dataSource.register, then spark.readStream.format(name). atom_of must give the same
    rows when asked again, so that a restarted query goes on where it stopped.
    """

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
            return _AtomReader(atom_of, per_second)

    return Source


class GeneratorSource:
    """Reads a generator as a stream in one call."""

    def __init__(self, spark: SparkSession, schema: str, atom_of: Callable[[int], Iterable[tuple] | None], per_second: float | None = None):
        self.spark, self.name = spark, f"atoms_{uuid.uuid4().hex}"
        spark.dataSource.register(generator(self.name, schema, atom_of, per_second))

    def read(self) -> DataFrame:
        return self.spark.readStream.format(self.name).load()


def throttled(spark: SparkSession, per_second: int) -> DataFrame:
    """A stream of numbers and times at so many rows a second. For a generator of one's own, see generator's per_second."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load()


class AtomFiles:
    """A folder that is pushed to: rows are held until fuse() ends the atom and writes it as one file.

    A stream over the folder sees one atom per micro-batch, in the order of their numbers if each micro-batch is one file and files are pushed
    one after the other; every row carries its atom, so operators that order by it don't depend on that.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        self.held: list[tuple] = []
        self.atoms, self.sealed = 0, False
        self.numbers = 0

    def submit(self, *row) -> None:
        if self.sealed:
            raise ValueError("the stream has been sealed")
        self.held.append((*row, self.atoms, self.numbers, None))
        self.numbers += 1

    def fuse(self) -> None:
        """Ends the atom."""
        rows = self.spark.createDataFrame(self.held, self._columns())
        rows.coalesce(1).write.mode("append").parquet(self.path)
        self.held, self.atoms = [], self.atoms + 1
        time.sleep(0.01)  # files are ordered by their time

    def error(self, reason: str) -> None:
        """Drops the open atom and ends the stream with an error, which those who read the stream get behind the atoms before it."""
        self.held, self.sealed = [(*[None] * len(StructType.fromDDL(self.schema)), self.atoms, self.numbers, reason)], True
        self.fuse()

    def seal(self) -> None:
        """No more rows; an open atom is ended first."""
        if self.held:
            self.fuse()
        self.sealed = True

    def _columns(self) -> str:
        return f"{self.schema}, __atom bigint, __seq bigint, __error string"

    def read(self, latest: bool = False) -> DataFrame:
        """The atoms as a stream, one per micro-batch; with latest only those that end after this call."""
        rows = self.spark.readStream.schema(self._columns()).option("maxFilesPerTrigger", 1).parquet(self.path)
        if latest:
            rows = rows.filter(F.col("__atom") >= self.atoms)
        failed = F.col("__error").isNotNull()
        return rows.filter(F.when(failed, F.raise_error(F.col("__error")).cast("boolean")).otherwise(F.lit(True))).drop("__error")
