"""State per key, per operator and per atom, as windows over the stream's order.

A window over a key holds that key's rows in one task. Where a key may hold a large share of all rows, split=True
gives the same rows through ``running``: the stream is cut into blocks of numbers, each block of a key is reduced to one row before anything global
is ordered, and the values before a block are added to those within it. Windows over all atoms always go that way.

Keys that are null make a group of their own. Without key columns (None) the contextual key is taken; an empty list of keys
means one state for the whole operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atomflow.functions import mixed
from atomflow.sources.batch import ATOM, KEY, SEQ

#: Numbers of the order that one window takes when a stream is split.
BLOCK = 1 << 16

#: How values are merged: within a window, and two merged values where either may be null.
_MERGES = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


def _order(keys: list[str], seq: str | list[str]):
    return W.partitionBy(*keys).orderBy(*([seq] if isinstance(seq, str) else seq))


def _keys(keys: list[str] | None) -> list[str]:
    return [KEY] if keys is None else keys


def running(
    df: DataFrame, values: dict[str, tuple[str, Column]], keys: list[str] | None, order: list[str] | None = None, exclusive: bool = False, block: Column | None = None
) -> DataFrame:
    """Merged values of all rows of the key up to each row, or before it (exclusive), with no key in one task.

    values: for each new column how values are merged (sum, min, max, or last for the last one that isn't null) and their expression.
    order: columns that tell the rows of a key apart; block: an expression that never falls along the order and
    is the same for a bounded number of rows of a key, by default the first column of the order over BLOCK.
    Only the blocks of a key, one row each, meet in one window.
    """
    keys, order = _keys(keys), order or [SEQ]
    block = F.floor(F.col(order[0]) / BLOCK) if block is None else block
    rows = df.withColumns({"__block": block, **{f"__of_{n}": c for n, (_, c) in values.items()}})
    place = F.struct(*order)
    totals = []
    for n, (op, _) in values.items():
        c = F.col(f"__of_{n}")
        totals.append((F.max_by(c, F.when(c.isNotNull(), place)) if op == "last" else _MERGES[op][0](c)).alias(f"__to_{n}"))
    blocks = rows.groupBy(*keys, "__block").agg(*totals)
    earlier = W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    own = [F.col(k).alias(f"__key_{i}") for i, k in enumerate([*keys, "__block"])]
    before = blocks.select(*own, *[_MERGES[op][0](F.col(f"__to_{n}")).over(earlier).alias(f"__before_{n}") for n, (op, _) in values.items()])
    within = W.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    rows = rows.withColumns({f"__within_{n}": _MERGES[op][0](F.col(f"__of_{n}")).over(within) for n, (op, _) in values.items()})
    same = F.lit(True)
    for i, k in enumerate([*keys, "__block"]):
        same = same & F.col(k).eqNullSafe(F.col(f"__key_{i}"))
    both = rows.join(before, same)
    merged = {n: _MERGES[op][1](F.col(f"__before_{n}"), F.col(f"__within_{n}")) for n, (op, _) in values.items()}
    return both.select(*[c for c in df.columns if c not in values], *[c.alias(n) for n, c in merged.items()])


def running_count(df: DataFrame, keys: list[str] | None, name: str = "n", seq: str = SEQ, split: bool = False) -> DataFrame:
    """How many rows of the key there are up to each row."""
    if split:
        return running(df, {name: ("sum", F.lit(1).cast("bigint"))}, keys, [seq])
    return df.withColumn(name, F.count("*").over(_order(_keys(keys), seq).rowsBetween(W.unboundedPreceding, 0)))


def running_sum(df: DataFrame, keys: list[str] | None, value: Column, name: str = "total", seq: str = SEQ, split: bool = False) -> DataFrame:
    """Sum of the key's values up to each row; give integers for a result that doesn't depend on the engine."""
    if split:
        return running(df, {name: ("sum", value)}, keys, [seq])
    return df.withColumn(name, F.sum(value).over(_order(_keys(keys), seq).rowsBetween(W.unboundedPreceding, 0)))


def running_sum_salted(df: DataFrame, keys: list[str] | None, value: Column, name: str = "total", seq: str = SEQ, atom: str = ATOM) -> DataFrame:
    """running_sum for keys of any size, with the stream's atoms as its blocks. The stream's order must follow the atoms."""
    return running(df, {name: ("sum", value)}, keys, [seq], block=F.col(atom))


def previous(df: DataFrame, keys: list[str] | None, value: str, default, name: str = "previous", seq: str = SEQ, split: bool = False) -> DataFrame:
    """The key's value before each row, or the default where there is none or it is null."""
    if split:
        out = running(df, {"__previous": ("last", F.struct(F.col(value).alias("v")))}, keys, [seq], exclusive=True)
        return out.withColumn(name, F.coalesce(F.col("__previous.v"), F.lit(default))).drop("__previous")
    return df.withColumn(name, F.coalesce(F.lag(value).over(_order(_keys(keys), seq)), F.lit(default)))


def previous_by_atom(df: DataFrame, value: str, default, name: str = "previous", seq: str = SEQ) -> DataFrame:
    """previous for the whole operator, split, so that no task gets all rows."""
    return previous(df, [], value, default, name, seq, split=True)


def count_per_atom(df: DataFrame, keys: list[str] | None, name: str = "n", atom: str = ATOM) -> DataFrame:
    """Counts that are emitted and reset when an atom ends."""
    return df.groupBy(atom, *_keys(keys)).agg(F.count("*").alias(name))


def cumulative_per_atom(df: DataFrame, aggregate: Column, name: str = "total", atom: str = ATOM, merge: str = "sum") -> DataFrame:
    """An aggregate that is emitted, but not reset, when an atom ends; merge says how the atoms' values go together (sum, min, max, last)."""
    ends = df.groupBy(atom).agg(aggregate.alias(name))
    return running(ends, {name: (merge, F.col(name))}, [], [atom])


def reservoir(df: DataFrame, k: int, number: str, atom: str = ATOM) -> DataFrame:
    """A sample of k rows of each atom: those that come first in a mixed order of their number."""
    order = W.partitionBy(atom).orderBy(mixed(F.col(number)), number)
    return df.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= k).drop("__rank")


def top(df: DataFrame, keys: list[str], n: int, name: str = "n") -> DataFrame:
    """The n most frequent keys, ties by key."""
    return df.groupBy(*keys).agg(F.count("*").alias(name)).orderBy(F.desc(name), *keys).limit(n)


def since_reset(df: DataFrame, keys: list[str] | None, reset: Column, name: str = "period", seq: str = SEQ, split: bool = False) -> DataFrame:
    """The number of resets of the key before each row: rows between two resets share it."""
    resets = reset.cast("bigint")
    if split:
        out = running(df, {name: ("sum", resets)}, keys, [seq], exclusive=True)
        return out.withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    before = _order(_keys(keys), seq).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(resets).over(before), F.lit(0)))
