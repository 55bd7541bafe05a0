"""Packed id matrices: rows of a fixed number of token ids, with segment lengths and position resets.

Documents are encoded, cut without loss where they are longer than a row, and packed by best fit decreasing:
pieces from long to short each go to the open row with the least room that still takes them.
That row is found in a segment tree over the possible amounts of room, whose nodes say whether any open row
has an amount below them. A task packs its documents in blocks of ``block`` tokens, so its memory
is bounded, nothing is shuffled, and a lost task is redone from its own input; a block
leaves at most a few rows part-filled.

Each result row: sequence_id (task and number in it), n_tokens, doc_ids and pieces of its segments,
cu_seqlens (0 and the running lengths of the segments), position_resets (where positions
start at 0 again, which is each segment's first place), starts (where the segment begins in its document) and
input_ids: capacity unsigned little-endian ids, 16 bits wide if the vocabulary allows, 32 otherwise, padded with
the end id.

Defined results: a null text is an empty one and makes a segment of the end id alone. Rows that repeat a
doc_id are separate documents; a null id is kept as null. Texts of any length are taken whole and cut into pieces. Pieces of equal length keep
their order. Only the columns for id and text are read, so others may have any names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomflow.llm.pieces import pieces_of
from atomflow.llm.tokens import ByteBpe, loaded

BLOCK = 1 << 20
SCHEMA = "sequence_id bigint, n_tokens int, doc_ids array<bigint>, pieces array<int>, starts array<bigint>, cu_seqlens array<int>, position_resets array<int>, input_ids binary"


class CapacityTree:
    """Open rows by the room they have; finds the least room of at least a given amount in log2(capacity) steps."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = self.size + room
        while at and not self.some[at]:
            self.some[at] = 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """A row with the least room of at least so much, and its room; the row is no longer in the tree."""
        at = self.size + least
        if not self.some[at]:
            while at > 1 and (at & 1 or not self.some[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at + (not self.some[2 * at])
        room = at - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.some[at] = 0
            at >>= 1
            while at and not (self.some[2 * at] or self.some[2 * at + 1]):
                self.some[at] = 0
                at >>= 1
        return row, room


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows as lists of the numbers of the pieces in them."""
    tree, rows = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        found = tree.take(n)
        if found:
            row, room = found
            rows[row].append(i)
        else:
            row, room = len(rows), capacity
            rows.append([i])
        if room > n:
            tree.add(room - n, row)
    return rows


def _packed(held: list[tuple], capacity: int, end_id: int, width: str, first: int) -> pa.RecordBatch:
    out: list[list] = [[] for _ in range(8)]
    for k, row in enumerate(best_fit_decreasing([p[3] for p in held], capacity)):
        parts = [held[i] for i in row]
        ends = np.cumsum([p[3] for p in parts]).tolist()
        ids = np.full(capacity, end_id, width)
        ids[: ends[-1]] = np.frombuffer(b"".join(p[4] for p in parts), "<u4")
        values = (first + k, ends[-1], [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts], [0, *ends], [0, *ends[:-1]], ids.tobytes())
        for c, v in zip(out, values, strict=True):
            c.append(v)
    types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


def _rows(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int, end_id: int, block: int) -> Iterator[pa.RecordBatch]:
    encoder = loaded(ByteBpe, tokenizer)
    width = "<u2" if encoder.size <= 1 << 16 and end_id < 1 << 16 else "<u4"
    end = np.array([end_id], "<u4").tobytes()
    at = TaskContext.get().partitionId() << 36
    held: list[tuple] = []
    total = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for k, start, n, ids in pieces_of(encoder.encode(text) + end, capacity):
                held.append((doc_id, k, start, n, ids))
                total += n
                if total >= block:
                    out = _packed(held, capacity, end_id, width, at)
                    at += len(out)
                    held, total = [], 0
                    yield out
    if held:
        yield _packed(held, capacity, end_id, width, at)


def packed_matrices(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 50256, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The packed rows of docs."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _rows(it, tokenizer, capacity, end_id, block), SCHEMA)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Writes the rows as Parquet, one row of the matrix in each; input_ids is its binary form."""
    packed.write.parquet(path)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """The rows that write_matrices wrote."""
    return spark.read.schema(SCHEMA).parquet(path)


def position_ids(cu_seqlens: list[int]) -> np.ndarray:
    """Positions of a row's tokens, from 0 in each segment."""
    return np.concatenate([np.arange(b - a) for a, b in zip(cu_seqlens[:-1], cu_seqlens[1:], strict=True)] or [np.empty(0, int)])
