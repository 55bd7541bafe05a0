"""Merging streams and routing them.

A sequencer merges streams atom by atom; a splitter sends each row to the first route whose condition holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atomflow.operators.keyed import BLOCK, running
from atomflow.sources.batch import ATOM, SEQ

INPUT = "__input"


def at_random(seed: int = 0) -> tuple[str | Column, ...]:
    """A policy that interleaves the inputs by chance, the same way each time, and keeps each input's own order."""
    jitter = F.pmod(F.xxhash64(F.lit(seed), F.col(INPUT), F.col(ATOM)), F.lit(1 << 20)) / (1 << 20)
    return (F.col(ATOM) + jitter, INPUT, SEQ)


class Sequencer:
    """An n-to-1 merge. Inputs can be connected at any time; the merge is planned when it is read.

    policy gives the order of the merged atoms: sort expressions over (__atom, __input), then __seq; within each input they must
    follow its atoms. A policy of one's own chooses the next atom by them.
    """

    ROUND_ROBIN = (ATOM, INPUT, SEQ)
    ONE_AFTER_ANOTHER = (INPUT, ATOM, SEQ)

    def __init__(self, *inputs: DataFrame, policy: tuple[str | Column, ...] = ROUND_ROBIN):
        self.inputs, self.policy = list(inputs), policy

    def connect(self, stream: DataFrame) -> Sequencer:
        self.inputs.append(stream)
        return self

    def merged(self) -> DataFrame:
        """All rows of all inputs with the ordinal of their input, and with their own atoms and numbers. Atoms without rows leave nothing."""
        parts = [df.withColumn(INPUT, F.lit(i)) for i, df in enumerate(self.inputs)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def in_order(self) -> DataFrame:
        return self.merged().orderBy(*self.policy)

    def numbered(self) -> DataFrame:
        """The merged stream with atoms and numbers of its own, from 0 in the order of the policy: what a workflow reads.

        Each atom of each input is an atom of the merged stream. Atoms are counted first, one row each; those are ordered in blocks, so no
        task gets all of them, and the rows of an atom are numbered by themselves. A stream that isn't a batch is ordered by
        its micro-batches and comes as it is.
        """
        rows = self.merged()
        if rows.isStreaming:
            return rows
        atoms = rows.groupBy(INPUT, ATOM).agg(F.count("*").alias("__n"))
        by = [p if isinstance(p, Column) else F.col(p) for p in self.policy[:-1]]
        atoms = atoms.withColumns({f"__by_{i}": c for i, c in enumerate(by)})
        order = [f"__by_{i}" for i in range(len(by))]
        by_input = isinstance(self.policy[0], str) and self.policy[0] == INPUT
        block = F.struct(INPUT, F.floor(F.col(ATOM) / BLOCK).alias("b")) if by_input else F.floor(F.col("__by_0") / BLOCK)
        counted = running(atoms, {"__first": ("sum", F.col("__n")), "__nr": ("sum", F.lit(1).cast("bigint"))}, [], order, exclusive=True, block=block)
        counted = counted.select(F.col(INPUT).alias("__i"), F.col(ATOM).alias("__a"), *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("__first", "__nr")))
        place = F.row_number().over(W.partitionBy(INPUT, ATOM).orderBy(SEQ)) - 1
        both = rows.withColumn("__place", place).join(counted, (F.col(INPUT) == F.col("__i")) & F.col(ATOM).eqNullSafe(F.col("__a")))
        return both.withColumns({ATOM: F.col("__nr"), SEQ: F.col("__first") + F.col("__place")}).select(*rows.columns)


class Splitter:
    """A 1-to-n router: routes are tried in the order in which they were added; rows that none takes are dropped."""

    def __init__(self, stream: DataFrame):
        self.stream, self.routes = stream, {}

    def split(self, name: str, condition: Column | Callable[[DataFrame], Column]) -> Splitter:
        if name in self.routes:
            raise ValueError(f"there is already a route {name!r}")
        self.routes[name] = condition
        return self

    def remove(self, name: str) -> Splitter:
        """Takes a route out; rows that it took go to later routes or nowhere."""
        del self.routes[name]
        return self

    def routed(self, column: str = "route") -> DataFrame:
        """The rows that some route takes, with its name, in one pass."""
        chosen = None
        for name, c in self.routes.items():
            c = c(self.stream) if callable(c) else c
            chosen = F.when(c, F.lit(name)) if chosen is None else chosen.when(c, F.lit(name))
        if chosen is None:
            return self.stream.withColumn(column, F.lit(None).cast("string")).filter(F.lit(False))
        return self.stream.withColumn(column, chosen).filter(F.col(column).isNotNull())

    def output(self, name: str) -> DataFrame:
        """The rows of one route."""
        return self.routed("__route").filter(F.col("__route") == name).drop("__route")
