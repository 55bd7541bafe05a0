"""Documents as token pieces of at most a given length, with nothing lost.

A document is the ids of its whole text followed by an end id. One that is longer than the capacity
is cut into pieces of exactly that length, but for the first, which takes what is over. A null text is an
empty one: its only piece is the end id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomflow.llm.text import parts_of
from atomflow.llm.tokens import ByteBpe, loaded


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n ids."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces_of(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(piece, start, length, ids) of a document's little-endian 32-bit ids."""
    for k, (at, n) in enumerate(cuts(len(ids) // 4, capacity)):
        yield k, at, n, ids[4 * at : 4 * (at + n)]


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int, end: bytes) -> Iterator[pa.RecordBatch]:
    encoder = loaded(ByteBpe, tokenizer)
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text in (row for p in parts_of(batch, 1) for row in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True)):
            for k, at, n, part in pieces_of(encoder.encode(text) + end, capacity):
                rows.append((doc_id, k, at, n, zlib.crc32(part)))
        cols = [np.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[1:] or [()] * 4, ("i4", "i8", "i8", "i8"), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *map(pa.array, cols)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""
    end = np.array([end_id], "<u4").tobytes()
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _pieces(it, tokenizer, capacity, end), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
