"""Keyed state machines, stashes and ordered folds.

The general forms run a Python fold over each key's rows in stream order: ``transformWithStateInPandas`` in streams and
``fold_sorted`` in batches, which walks sorted Arrow batches and holds one of them and one key's state at a time. A
machine whose state is decided by the last state-setting row has a window form, which stays in the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string

from atomflow.operators.keyed import _keys, running
from atomflow.sources.batch import ATOM, SEQ

Handler = Callable[..., tuple[str, list[tuple]]]
_STASH = "_stash"


def reset_machine(df: DataFrame, keys: list[str] | None, sets_state: Column, default, name: str = "state", seq: str = SEQ, split: bool = False) -> DataFrame:
    """The state before each row, where sets_state is the state a row switches to, or null. split: for keys of any size."""
    if split:
        out = running(df, {name: ("last", sets_state)}, keys, [seq], exclusive=True)
        return out.withColumn(name, F.coalesce(name, F.lit(default)))
    before = W.partitionBy(*_keys(keys)).orderBy(seq).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.last(sets_state, ignorenulls=True).over(before), F.lit(default)))


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, dict], tuple[object, list[tuple]]], schema: str) -> DataFrame:
    """Folds the rows of each key in order: step gives the state after a row and the rows to emit.

    The rows are dealt by key, sorted and walked batch by batch, so a key of any size costs the memory of a batch
    and of its state; the rows of one key are handled in one task, since each may depend on all before it.
    """
    target = to_arrow_schema(_struct(schema))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            names, out = batch.schema.names, []
            at = [names.index(k) for k in keys]
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = tuple(values[i] for i in at)
                if state is None or own != key:
                    key, state = own, start()
                state, rows = step(state, dict(zip(names, values, strict=True)))
                out += rows
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)

    dealt = df.repartition(*keys) if keys else df.coalesce(1)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(fold, schema)


def _struct(schema: str) -> StructType:
    return _parse_datatype_string(schema)


class Stash:
    """Rows of a key that wait to be handled, in the machine's memory; they are replayed in the order in which they came."""

    def __init__(self, memory: dict, handler: Callable):
        self.memory, self.handler = memory, handler

    def stash(self, row: dict) -> None:
        self.memory.setdefault(_STASH, []).append(row)

    def size(self) -> int:
        return len(self.memory.get(_STASH, ()))

    def unstash_all(self) -> list[tuple]:
        """Gives all waiting rows to the behaviour that calls this, and what that emits; rows that it stashes again wait on."""
        waiting, self.memory[_STASH] = self.memory.get(_STASH, []), []
        return [out for row in waiting for out in self.handler(row, self.memory, self)[1]]


def _handle(behaviours: dict[str, Handler], stash: bool, state: str, memory: dict, row: dict) -> tuple[str, list[tuple]]:
    handler = behaviours[state]
    return handler(row, memory, Stash(memory, handler)) if stash else handler(row, memory)


def machine(df: DataFrame, keys: list[str] | None, behaviours: dict[str, Handler], start: str, schema: str, seq: str = SEQ, stash: bool = False) -> DataFrame:
    """A virtual state machine per key.

    Each behaviour gets (row, memory), with stash also the key's Stash, and returns the name of the next behaviour and the rows to
    emit; memory is a dictionary of the key's own. Behaviours are named, never stored as code. In a stream, df must be
    an append-only one, and the memory must be what JSON can hold; then the same rows come out as of a batch.
    """
    keys = _keys(keys)
    if df.isStreaming:
        columns = [f.name for f in _struct(schema)]
        df, shape = _Shape.of(df, [*keys, seq])
        return df.groupBy(*keys).transformWithStateInPandas(MachineProcessor(behaviours, start, columns, seq, stash, shape), schema, "Append", "None")

    def step(state: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        behaviour, rows = _handle(behaviours, stash, *state, row)
        return (behaviour, state[1]), rows

    return fold_sorted(df, keys, [seq], lambda: (start, {"n": 0}), step, schema)


@dataclass(frozen=True)
class _Shape:
    """Columns of the rows that a stateful operator gets: all names, since those that begin with an underscore come under others, and
    those that are integers sent as text, since pandas would make floats of integers with nulls among them."""

    names: tuple[str, ...]
    whole: tuple[str, ...]

    @staticmethod
    def of(df: DataFrame, keep: list[str]) -> tuple[DataFrame, _Shape]:
        whole = tuple(f.name for f in df.schema if f.dataType.typeName() in ("long", "integer", "short", "byte") and f.name not in keep)
        return df.withColumns({c: F.col(c).cast("string") for c in whole}), _Shape(tuple(df.columns), whole)


def _rows(frames: Iterator[pd.DataFrame], order: list[str], shape: _Shape | None) -> list[dict]:
    """The rows of an atom in order, with None for what is missing."""
    rows = pd.concat(list(frames))
    if shape:
        rows.columns = list(shape.names)
    rows = rows.sort_values(order, kind="stable")
    out = rows.astype(object).where(rows.notna(), None).to_dict("records")
    for r in out:
        for c in shape.whole if shape else ():
            if r[c] is not None:
                r[c] = int(r[c])
    return out


def _kept(memory: dict) -> str:
    stored = json.dumps(memory, default=lambda x: x.item())
    if json.loads(stored) != memory:
        raise ValueError(f"JSON doesn't keep this memory as it is: {memory!r}")
    return stored


class MachineProcessor(StatefulProcessor):
    """The streaming form of machine: the behaviour's name and the whole memory, as JSON, in the state store.

    The memory starts as {"n": 0}. One that JSON doesn't give back as it was (keys other than strings, tuples) raises.
    """

    def __init__(self, behaviours: dict[str, Handler], start: str, columns: list[str], seq: str = SEQ, stash: bool = False, shape: _Shape | None = None):
        self.behaviours, self.start, self.columns, self.seq, self.stash, self.shape = behaviours, start, columns, seq, stash, shape

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("machine", "behaviour string, memory string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, stored = self.state.get() if self.state.exists() else (self.start, '{"n": 0}')
        memory, out = json.loads(stored), []
        for row in _rows(rows, [self.seq], self.shape):
            state, new = _handle(self.behaviours, self.stash, state, memory, row)
            out += new
        self.state.update((state, _kept(memory)))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def stash_until(df: DataFrame, keys: list[str] | None, ready: Column, seq: str = SEQ) -> DataFrame:
    """Rows wait per key until the first row for which ready holds, then all go on in order.

    Adds __released: the number at which a row leaves the stash. Rows of keys that never get ready stay and aren't returned. The
    first ready row is found per key before the shuffle, so a key of any size can be split.
    """
    keys = _keys(keys)
    own = [F.col(k).alias(f"__key_{i}") for i, k in enumerate(keys)]
    first = df.filter(ready).groupBy(*own).agg(F.min(seq).alias("__ready"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__key_{i}"))
    released = df.join(first, same).withColumn("__released", F.greatest(F.col(seq), F.col("__ready")))
    return released.select(*df.columns, "__released")


def sagas(operations: DataFrame, groups: list[str], opening: dict[int, int] | None = None, seq: str = SEQ) -> DataFrame:
    """Transactions over accounts, one after the other: all operations of a saga succeed, or none takes effect.

    operations: saga, __seq, kind (deposit, withdraw), account, amount; a saga's operations follow each other in __seq. A withdrawal
    succeeds if the balance covers it. The result depends on the order of all sagas that may share accounts, so those are folded in one
    task: groups names the columns whose values tell independent groups of accounts apart.
    """
    whole = operations.groupBy(*groups, "saga").agg(
        F.min(seq).alias("__first"), F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), "kind", "account", "amount"))).alias("__ops")
    )

    def step(balance: dict, row: dict) -> tuple[dict, list[tuple]]:
        new: dict[int, int] = {}
        for op in row["__ops"]:
            have = new.get(op["account"], balance.get(op["account"], 0))
            if op["kind"] == "withdraw" and have < op["amount"]:
                return balance, [(row["saga"], False)]
            new[op["account"]] = have + (op["amount"] if op["kind"] == "deposit" else -op["amount"])
        balance.update(new)
        return balance, [(row["saga"], True)]

    return fold_sorted(whole, groups, ["__first"], lambda: dict(opening or {}), step, "saga bigint, success boolean")


OnRow = Callable[[dict, dict], list[tuple]]


def serve(
    events: DataFrame, requests: DataFrame, keys: list[str], on_event: Callable[[dict, dict], None], on_request: OnRow, schema: str, seq: str = SEQ, atom: str = ATOM
) -> DataFrame:
    """A replier: events and requests of a key share its memory, in batches and in streams.

    on_event gets (row, memory); on_request gets (row, memory), may change the memory too, and returns the replies. Rows are handled by
    (__atom, events before requests, __seq). The columns of either side that the other lacks are null. Both sides are batches or both are
    streams; in a stream, what arrives in one micro-batch is one atom or several.
    """
    both = events.withColumn("__role", F.lit(0)).unionByName(requests.withColumn("__role", F.lit(1)), allowMissingColumns=True)

    def handle(row: dict, memory: dict) -> list[tuple]:
        if row["__role"]:
            return on_request(row, memory)
        on_event(row, memory)
        return []

    order = [atom, "__role", seq]
    if both.isStreaming:
        columns = [f.name for f in _struct(schema)]
        both, shape = _Shape.of(both, [*keys, *order])
        return both.groupBy(*keys).transformWithStateInPandas(_Served(handle, columns, order, shape), schema, "Append", "None")
    return fold_sorted(both, keys, order, dict, lambda memory, row: (memory, handle(row, memory)), schema)


class _Served(StatefulProcessor):
    """The streaming form of serve: the key's memory as JSON in the state store."""

    def __init__(self, handle: OnRow, columns: list[str], order: list[str], shape: _Shape):
        self.handle, self.columns, self.order, self.shape = handle, columns, order, shape

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("memory", "memory string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        memory = json.loads(self.state.get()[0]) if self.state.exists() else {}
        out = [new for row in _rows(rows, self.order, self.shape) for new in self.handle(row, memory)]
        self.state.update((_kept(memory),))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass
