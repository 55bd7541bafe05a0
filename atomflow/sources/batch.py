"""Bounded sources."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import zip_longest

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atomflow.functions import hash_code

ATOM, SEQ, KEY = "__atom", "__seq", "__key"
META = (ATOM, SEQ, KEY)


def _schema(value_type: str | T.DataType) -> T.StructType:
    kind = T._parse_datatype_string(value_type) if isinstance(value_type, str) else value_type
    fields = kind.fields if isinstance(kind, T.StructType) else [T.StructField("v", kind)]
    return T.StructType([*fields, T.StructField(ATOM, T.LongType()), T.StructField(SEQ, T.LongType()), T.StructField(KEY, T.LongType())])


def from_lists(spark: SparkSession, atoms: Iterable[Iterable], value_type: str | T.DataType = "bigint", keys: Iterable[Iterable[int]] | None = None) -> DataFrame:
    """One atom per inner list; with keys, an inner pair of lists ends with the shorter one.

    Without keys, a value's key is the hash that a JVM gives it (functions.hash_code): an integer is its own, and what is
    neither text, number nor boolean has a null key.
    """
    schema = _schema(value_type)
    wide = len(schema.fields) > 4 or schema.fields[0].name != "v"
    rows, seq = [], 0
    for atom, (values, own) in enumerate(zip_longest(atoms, keys or (), fillvalue=None)):
        if values is None or (keys is not None and own is None):
            break
        pairs = zip(values, own, strict=False) if own is not None else ((v, hash_code(v)) for v in values)
        for v, k in pairs:
            rows.append((*(v if wide else (v,)), atom, seq, k))
            seq += 1
    return spark.createDataFrame(rows, schema)


def from_list(spark: SparkSession, values: Iterable, value_type: str | T.DataType = "bigint", keys: Sequence[int] | None = None) -> DataFrame:
    """All values in one atom. Iterators are taken to their end."""
    return from_lists(spark, [values], value_type, None if keys is None else [keys])


def from_range(spark: SparkSession, start: int, end: int, atom: int) -> DataFrame:
    """The integers from start up to end, without end, in atoms of so many; made by the executors."""
    v = F.col("id")
    return spark.range(start, end).select(v.alias("v"), F.floor((v - start) / atom).cast("bigint").alias(ATOM), (v - start).alias(SEQ), v.alias(KEY))


def signal(spark: SparkSession, value, value_type: str | T.DataType = "bigint") -> DataFrame:
    """A single value in a single atom."""
    return from_list(spark, [value], value_type)


def empty(spark: SparkSession, value_type: str | T.DataType = "bigint") -> DataFrame:
    """No rows, with a schema."""
    return from_list(spark, [], value_type)


def with_atoms(df: DataFrame, order: Column | str, size: int, key: Column | str | None = None) -> DataFrame:
    """Makes a stream of a table with a dense integer order: atoms of so many numbers.

    The order column is arithmetic, so nothing is sorted or shuffled. For a table without such a column, number it
    first, for instance with zipWithIndex or a window over its partitions.
    """
    seq = F.col(order) if isinstance(order, str) else order
    own = seq if key is None else F.col(key) if isinstance(key, str) else key
    return df.withColumns({ATOM: F.floor(seq / size).cast("bigint"), SEQ: seq.cast("bigint"), KEY: own.cast("bigint")})
