"""Cycles and recursion: streams that are fed back, and requests that ask themselves."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def recursive(spark: SparkSession, seed: DataFrame, step: str, keep: str, levels: int = 1000) -> DataFrame:
    """All rows of a feedback loop, by a recursive query.

    step: the select list over r that makes the next row of a row; keep: the condition on r under which it goes on.
    levels bounds the depth; a deeper loop fails rather than being cut off. LIMIT ALL lifts Spark's cap on the number of rows
    (spark.sql.cteRecursionRowLimit, a million by default), so none ends the loop.
    """
    name = f"loop_seed_{uuid.uuid4().hex}"
    seed.createOrReplaceTempView(name)
    cols = ", ".join(seed.columns)
    return spark.sql(
        f"WITH RECURSIVE r({cols}) MAX RECURSION LEVEL {levels} AS (SELECT {cols} FROM {name} UNION ALL SELECT {step} FROM r WHERE {keep}) SELECT * FROM r LIMIT ALL"
    )


def until_empty(start: DataFrame, step: Callable[[DataFrame], tuple[DataFrame, DataFrame]], rounds: int = 10_000, checkpoint_every: int = 1) -> DataFrame:
    """Runs a loop in the driver until nothing is fed back; returns everything that came out.

    step gives (output, feedback) for the rows of a round. Lineage is cut by reliable checkpoints, so a lost executor
    doesn't replay the loop.
    """
    rows, outputs = start.checkpoint(), []
    for n in range(rounds):
        if rows.isEmpty():
            break
        out, back = step(rows)
        outputs.append(out)
        rows = back.checkpoint() if n % checkpoint_every == 0 else back
    else:
        raise RuntimeError(f"the loop still had rows after {rounds} rounds")
    if not outputs:
        return step(start)[0]
    total = outputs[0]
    for o in outputs[1:]:
        total = total.unionByName(o)
    return total


def fibonacci(spark: SparkSession, n: int) -> DataFrame:
    """n and fib(n) for all numbers up to n: two asks per request, awaited and summed, as an iterative pair."""
    seed = spark.range(1).select(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("a"), F.lit(1).cast("bigint").alias("b"))
    return recursive(spark, seed, "n + 1, b, a + b", f"n < {n}", n + 2).select("n", F.col("a").alias("fib"))


def countdown(spark: SparkSession, start: DataFrame, value: str, step: int = 1, levels: int = 2000) -> DataFrame:
    """Every request down to 0 of a request that asks for the value below itself."""
    others = [c for c in start.columns if c != value]
    cols = start.select(*others, value)
    return recursive(spark, cols, ", ".join([*others, f"{value} - {step}"]), f"{value} >= {step}", levels)


def ask_tree(
    requests: DataFrame, key: list[str], leaf: Column, value: Column, asks: Column, combine: Callable[[str], Column], levels: int = 100
) -> DataFrame:
    """Requests that ask several others, await them all and reply with what they combine to; the asked ones do the same.

    key tells the requests apart; leaf: which requests are answered at once, with value; asks: the requests that any other makes, an
    array of structs with all columns but the key; combine: an aggregate over the replies, given their column's name.
    Returns the key, the reply and calls, the number of requests made for it, itself included. All requests of a level are handled together, down
    to the leaves and up again, each level checkpointed; a tree deeper than levels fails.
    """
    fields = [c for c in requests.columns if c not in key]
    rows = requests.withColumn("__path", F.lit("")).checkpoint()
    down: list[DataFrame] = []
    while not rows.isEmpty():
        if len(down) == levels:
            raise RuntimeError(f"requests were still asking after {levels} levels")
        down.append(rows)
        asked = rows.filter(~leaf).select(*key, "__path", F.posexplode(asks).alias("__nr", "__ask"))
        path = F.concat("__path", F.lit("/"), F.col("__nr").cast("string"))
        rows = asked.select(*key, *[F.col("__ask")[c].alias(c) for c in fields], path.alias("__path")).checkpoint()
    up: DataFrame | None = None
    for rows in reversed(down):
        own = rows.filter(leaf).select(*key, "__path", value.alias("reply"), F.lit(1).cast("bigint").alias("calls"))
        if up is not None:
            parent = F.regexp_replace("__path", "/[0-9]+$", "")
            told = up.withColumn("__path", parent).groupBy(*key, "__path").agg(combine("reply").alias("reply"), (F.sum("calls") + 1).alias("calls"))
            own = own.unionByName(told)
        up = own.checkpoint()
    return requests.select(*key, value.alias("reply"), F.lit(1).cast("bigint").alias("calls")).limit(0) if up is None else up.drop("__path")
