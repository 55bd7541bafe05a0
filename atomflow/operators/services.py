"""Request and reply between streams, planned as projections, joins and windows.

A service is declared by one replier. Asking is planned as what the reply depends on: nothing (a projection), state by
key (a left join), state that changes along the stream (the value as of the request), the request before (a lag). Continuations
after a reply are projections over the joined row, so no closure is ever stored. In an atom, updates come before requests. A replier
whose events and requests share a state of any kind is operators.machines.serve, in batches and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atomflow.operators import keyed
from atomflow.sources.batch import ATOM, SEQ


def ask_stateless(requests: DataFrame, reply: Column, name: str = "reply") -> DataFrame:
    """The reply is an expression over the request."""
    return requests.withColumn(name, reply)


def ask_keyed(requests: DataFrame, state: DataFrame, key: list[str], replies: dict[str, Column]) -> DataFrame:
    """The reply is looked up by the request's key; null if there is none.

    key: columns that both tables have; replies: expressions over the columns of state. Whether the state is
    broadcast is left to the planner, which knows its size.
    """
    found = state.select(*key, *[c.alias(n) for n, c in replies.items()])
    return requests.join(found, key, "left")


def ask_as_of(
    requests: DataFrame, updates: DataFrame, value: str, name: str = "reply", keys: list[str] | None = None, running: str | None = "sum", default=None, split: bool = False
) -> DataFrame:
    """The reply is the state as of the request: the running sum (or with running=None the latest value that isn't null) of all updates
    that come before it by (__atom, __seq), updates of the same atom included.

    Per key, one window over updates and requests; with split, keys of any size (blocks of atoms first). Without keys, values are merged
    per atom first, then in blocks of atoms. Requests without an atom come before all others.
    """
    op = "sum" if running else "last"
    if keys:
        both = updates.select(*keys, ATOM, SEQ, F.col(value).alias("__v"), F.lit(0).alias("__role"))
        asked = requests.withColumn("__role", F.lit(1)).withColumn("__v", F.lit(None).cast(both.schema["__v"].dataType))
        rows = asked.unionByName(both, allowMissingColumns=True)
        if split:
            rows = keyed.running(rows, {name: (op, F.col("__v"))}, keys, [ATOM, "__role", SEQ])
        else:
            upto = W.partitionBy(*keys).orderBy(ATOM, "__role", SEQ).rowsBetween(W.unboundedPreceding, 0)
            rows = rows.withColumn(name, F.sum("__v").over(upto) if running else F.last("__v", ignorenulls=True).over(upto))
        out = rows.filter("__role = 1").drop("__role", "__v")
        return out if default is None else out.withColumn(name, F.coalesce(name, F.lit(default)))
    latest = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(SEQ)))
    per_atom = updates.groupBy(ATOM).agg((F.sum(value) if running else latest).alias("__v"))
    atoms = requests.select(F.col(ATOM)).distinct().withColumn("__v", F.lit(None).cast(per_atom.schema["__v"].dataType))
    calendar = atoms.unionByName(per_atom).groupBy(ATOM).agg(F.max("__v").alias("__v"))
    known = keyed.running(calendar, {"__known": (op, F.col("__v"))}, [], [ATOM])
    known = known.select(F.col(ATOM).alias("__at"), F.col("__known") if default is None else F.coalesce("__known", F.lit(default)).alias("__known"))
    joined = requests.join(known, F.col(ATOM).eqNullSafe(F.col("__at")), "left")
    return joined.withColumn(name, F.col("__known")).drop("__at", "__known")


def ask_then_write(requests: DataFrame, value: str, default, keys: list[str], name: str = "reply", split: bool = False) -> DataFrame:
    """A cell per key: the reply is what the request before wrote, then the request's value is written. split: keys of any size."""
    if split:
        out = keyed.running(requests, {"__cell": ("last", F.struct(F.col(value).alias("v")))}, keys, [ATOM, SEQ], exclusive=True)
        return out.withColumn(name, F.coalesce(F.col("__cell.v"), F.lit(default))).drop("__cell")
    order = W.partitionBy(*keys).orderBy(ATOM, SEQ)
    return requests.withColumn(name, F.coalesce(F.lag(value).over(order), F.lit(default)))


def await_all(requests: DataFrame, services: list[tuple[DataFrame, list[str], dict[str, Column]]], **results: Column) -> DataFrame:
    """Asks several keyed services and goes on when all have replied: joins one after the other, then the results."""
    for state, key, replies in services:
        requests = ask_keyed(requests, state, key, replies)
    return requests.withColumns(results)
