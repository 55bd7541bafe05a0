"""Flows: chains of row operators over one stream.

A Flow is an immutable view of a DataFrame, so using one twice fans out. Each operator is a DataFrame operation; Catalyst
fuses chains of them. Results are defined over (__atom, __seq), never over arrival.
"""

from __future__ import annotations

import logging
import re
import threading
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from atomflow.functions import sampled
from atomflow.operators import keyed
from atomflow.sources.batch import ATOM, KEY, META, SEQ

log = logging.getLogger("atomflow")


class Factory:
    """Makes an operator, or another factory, when the plan is built. It must have no side effects."""

    def __init__(self, make: Callable):
        self.make = make


def _same(df: DataFrame) -> DataFrame:
    return df


class Flow:
    """A stream inside a workflow: the flows it takes rows from, the handler of those rows, and what that gives.

    A source takes rows from no flow and a union from several; both hand them on as they are.
    """

    def __init__(
        self, df: DataFrame, inputs: tuple[Flow, ...] = (), handler: Callable[[DataFrame], DataFrame] = _same, name: str | None = None, arriving: DataFrame | None = None
    ):
        self.df, self.inputs, self.handler, self.name = df, inputs, handler, name
        self.arriving = df if arriving is None else arriving

    def _then(self, handler: Callable[[DataFrame], DataFrame], name: str | None = None) -> Flow:
        return Flow(handler(self.df), (self,), handler, name, self.df)

    def _with(self, handler: Callable[[DataFrame], DataFrame]) -> Flow:
        """The same operator with another handler."""
        return Flow(handler(self.arriving), self.inputs, handler, self.name, self.arriving)

    def _each(self, change: Callable[[Flow], Flow], done: dict[int, Flow] | None = None) -> Flow:
        """The same graph with every operator changed, unions too; a flow that is used twice is changed once."""
        done = {} if done is None else done
        if id(self) not in done:
            if not self.inputs:
                done[id(self)] = self
            else:
                inputs = tuple(i._each(change, done) for i in self.inputs)
                arriving = _united([i.df for i in inputs])
                done[id(self)] = change(Flow(self.handler(arriving), inputs, self.handler, self.name, arriving))
        return done[id(self)]

    # Row operators

    def map(self, **columns: Column) -> Flow:
        """One row in, one out: the named expressions replace the row's values."""
        return self._then(lambda df: df.select(*[c.alias(n) for n, c in columns.items()], *_meta(df)), "map")

    def with_columns(self, **columns: Column) -> Flow:
        """A map that keeps the other values."""
        return self._then(lambda df: df.withColumns(columns), "map")

    def flat_map(self, name: str, values: Column, *keep: str) -> Flow:
        """One row for each element of an array, in order; __seq is kept, and __pos tells the element."""
        return self._then(lambda df: df.select(*keep, F.posexplode(values).alias("__pos", name), *_meta(df)), "flat_map")

    def filter(self, condition: Column) -> Flow:
        return self._then(lambda df: df.filter(condition), "filter")

    def processor(self, handler: Callable[[DataFrame], DataFrame]) -> Flow:
        """Any handler of the rows that is a DataFrame function; stateful ones are in operators.machines."""
        return self._then(handler, "processor")

    task = processor

    def init(self, factory: Factory | Callable[[], Callable[[DataFrame], DataFrame]]) -> Flow:
        """Builds the operator when the plan is built; a factory may make another factory."""
        made = factory if isinstance(factory, Factory) else factory()
        while isinstance(made, Factory):
            made = made.make()
        return self._then(made, "init")

    def identity(self) -> Flow:
        return self._then(lambda df: df, "identity")

    def sample(self, one_in: int, seed: int | None = None) -> Flow:
        """One row in so many: by chance with a seed, otherwise always the same ones by __seq."""
        chosen = F.rand(seed) < 1 / one_in if seed is not None else sampled(F.col(SEQ), one_in)
        return self._then(lambda df: df.filter(chosen), "sample")

    def key(self, key: Column) -> Flow:
        """Sets the contextual key: the keyed operators partition by it unless they are given columns."""
        return self._then(lambda df: df.withColumn(KEY, key.cast("bigint")), "key")

    def ranges(self, partitions: int) -> Flow:
        """Deals the rows into so many ranges of the contextual key; a null key is in the first."""
        return self._then(lambda df: df.repartitionByRange(partitions, KEY), "ranges")

    def check_expected_type(self, schema: str | StructType) -> Flow:
        """Fails when the plan is built if the values have another schema."""
        want = schema if isinstance(schema, StructType) else self.df.sparkSession.createDataFrame([], schema).schema
        have = [(f.name, f.dataType) for f in self.df.schema if not f.name.startswith("__")]
        if have != [(f.name, f.dataType) for f in want]:
            raise TypeError(f"expected {want.simpleString()}, got {have}")
        return self

    def with_name(self, name: str) -> Flow:
        return Flow(self.df.alias(name), self.inputs, self.handler, name, self.arriving)

    def logger(self, prefix: str = "") -> Flow:
        """Logs the plan's columns and forwards every row; the count of rows is observed, and logged when the first action ends.

        In a stream the counts of the micro-batches are in the metrics observed under the prefix, for a query listener.
        """
        log.info("%s%s", prefix, self.df.columns)
        return self._then(lambda df: _counted(df, prefix), "logger")

    def nothing(self) -> Flow:
        """Drops every row and keeps the type."""
        return self._then(lambda df: df.filter(F.lit(False)), "nothing")

    consume = nothing

    def empty(self, schema: str) -> Flow:
        """Drops every row and changes the type."""
        cols = self.df.sparkSession.createDataFrame([], schema).schema
        return self._then(lambda df: df.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in cols], *_meta(df)).filter(F.lit(False)), "empty")

    # Composition

    def union(self, *others: Flow) -> Flow:
        """All rows of all flows, atom by atom."""
        df = _united([self.df, *(o.df for o in others)])
        return Flow(df, (self, *others), _same, "union")

    def combine_all_from(self, others: Iterable[Flow], task: Callable[[DataFrame], DataFrame]) -> Flow:
        return self.union(*others).task(task)

    def split(self, *conditions: Column) -> tuple[Flow, ...]:
        """One flow per condition, independently: a row may go to several or to none."""
        return tuple(self.filter(c) for c in conditions)

    def sink(self) -> DataFrame:
        """The stream's rows; several sinks of a workflow are united by App.workflow."""
        return self.df

    # Hooks

    def with_on_next(self, handler: Callable[[DataFrame], DataFrame]) -> Flow:
        """Another handler in place of the latest one; behind a union or on a source it gets all their rows."""
        return self._with(handler)

    def with_on_error(self, column: str, value: Column, fallback: Column, *given: Column) -> Flow:
        """A value that may fail to be computed (give a try_ expression, null on failure) and what stands for it then.

        given: what the value is computed from. Where some of it is null, so is the value, which is no failure; without
        it every null counts as one.
        """
        failed = value.isNull()
        for c in given:
            failed = failed & c.isNotNull()
        return self._then(lambda df: df.withColumn(column, F.when(failed, fallback).otherwise(value)), "on_error")

    def with_on_atom_complete(self, cumulative: bool | dict[str, str] = False, atoms: DataFrame | None = None, **aggregates: Column) -> Flow:
        """Behind the rows of each atom, one row with aggregates of the atom, or of all atoms up to it; missing columns are null.

        cumulative: names how the atoms' values of an aggregate are merged (sum, min, max, last); True finds that out for
        sums, counts, minima and maxima and refuses all others. atoms: a table with all atoms of the stream in __atom; those
        without rows get a row too.
        """
        merges = {n: _merge_of(n, c) for n, c in aggregates.items()} if cumulative is True else cumulative or {}

        def handler(df: DataFrame) -> DataFrame:
            columns = [c.alias(n) for n, c in aggregates.items()]
            ends = df.groupBy(ATOM).agg(*columns, F.max(SEQ).alias(SEQ))
            if atoms is not None:
                none = df.sparkSession.createDataFrame([], df.schema).agg(*columns).first()
                calendar = atoms.select(F.col(ATOM).alias("__at")).distinct()
                ends = calendar.join(ends, F.col("__at").eqNullSafe(F.col(ATOM)), "left")
                missing = F.col(ATOM).isNull() & F.col("__at").isNotNull()
                filled = [F.when(missing, F.lit(none[n])).otherwise(F.col(n)).alias(n) for n in aggregates]
                ends = ends.select(*filled, SEQ, F.col("__at").alias(ATOM))
            if merges:
                ends = keyed.running(ends, {n: (op, F.col(n)) for n, op in merges.items()}, [], [ATOM])
            return df.unionByName(ends.withColumn("__end", F.lit(True)), allowMissingColumns=True)

        return self._then(handler, "on_atom_complete")

    def all_with_on_atom_complete(self, **aggregates: Column) -> Flow:
        """The hook on every operator so far, each seeing its own output."""
        return self._each(lambda flow: flow.with_on_atom_complete(**aggregates))

    def with_on_complete(self, **aggregates: Column) -> Flow:
        """Behind all rows, one row with aggregates of the whole stream."""

        def handler(df: DataFrame) -> DataFrame:
            end = df.agg(*[c.alias(n) for n, c in aggregates.items()], F.max(ATOM).alias(ATOM), F.max(SEQ).alias(SEQ))
            return df.unionByName(end, allowMissingColumns=True)

        return self._then(handler, "on_complete")

    def with_wrapper(self, wrapper: Callable[[DataFrame, Callable[[DataFrame], DataFrame]], DataFrame]) -> Flow:
        """Around advice: the wrapper gets the rows before the latest operator, and that operator."""
        handler = self.handler
        return self._with(lambda df: wrapper(df, handler))

    def all_with_wrapper(self, wrapper: Callable[[DataFrame, Callable[[DataFrame], DataFrame]], DataFrame]) -> Flow:
        """Around advice on every operator so far."""
        return self._each(lambda flow: flow.with_wrapper(wrapper))

    def with_and_then(self, handler: Callable[[DataFrame], DataFrame]) -> Flow:
        """Fuses another operator behind the latest one."""
        first = self.handler
        return Flow(handler(self.df), self.inputs, lambda df: handler(first(df)), self.name, self.arriving)

    def steps(self, column: str, behaviours: Sequence[tuple[Column, int]]) -> Flow:
        """Rotating behaviour: the first expression holds for so many atoms, then the next, and so on, in a cycle."""
        cycle = sum(n for _, n in behaviours)
        at, upto = F.pmod(F.col(ATOM), F.lit(cycle)), 0
        chosen = None
        for value, n in behaviours:
            upto += n
            chosen = F.when(at < upto, value) if chosen is None else chosen.when(at < upto, value)
        return self._then(lambda df: df.withColumn(column, chosen), "steps")


def _counted(df: DataFrame, prefix: str) -> DataFrame:
    rows = F.count(F.lit(1)).alias("rows")
    if df.isStreaming:
        return df.observe(prefix or "rows", rows)
    seen = Observation()
    observed = df.observe(seen, rows)

    def wait() -> None:
        try:
            log.info("%s%d rows", prefix, seen.get["rows"])
        except Exception:  # the session ended before any action
            log.debug("%snot counted", prefix)

    threading.Thread(target=wait, daemon=True).start()
    return observed


def _united(parts: Sequence[DataFrame]) -> DataFrame:
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df


def _merge_of(name: str, aggregate: Column) -> str:
    """How values of an aggregate are merged, by its outermost function."""
    found = re.match(r"Column<'(\w+)\(", str(aggregate))
    merge = {"sum": "sum", "count": "sum", "min": "min", "max": "max"}.get(found[1].lower() if found else "")
    if merge is None:
        raise ValueError(f"say how the atoms' values of {name} are merged: cumulative={{{name!r}: ...}}")
    return merge


def _meta(df: DataFrame) -> list[str]:
    return [c for c in META if c in df.columns]
