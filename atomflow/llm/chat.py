"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold a conversation several times: as it stood after two turns, after four,
and so on. A conversation that is a prefix of a longer one, turn by turn in role and text, is
a snapshot and goes; of conversations that are equal throughout, the smallest id stays. What
is left is maximal, and is rendered to one training text each.

Each turn gets a digest of its role and text; the exclusive-or of the digests of (position,
turn) up to a turn is the rolling hash of that prefix, 120 bits wide. The whole-conversation
hashes are reduced to one row per distinct (length, hash) before the anti-join against the
distinct proper prefixes, so a first turn or a conversation that a third of the rows share
costs one row per task on either side. Only DataFrame operations run.

Defined results: turns are ordered by turn, then role, then text (nulls first); identical rows
of a conversation count once, so repeated log lines don't matter. A null role or text is kept
apart from an empty one in comparisons and rendered as empty. A null turn comes first. Rows
without a conversation id form one conversation with a null id. An empty table gives no rows;
further columns are ignored, whatever their names. A rendered conversation is one row, so its
turns must fit in a task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def _half(digest: Column, at: int) -> Column:
    """60 bits of a hexadecimal digest as a number."""
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint")


def turns_with_prefixes(logs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Distinct turns with their position from 1 and the rolling hash (h1, h2) of the prefix that they end."""
    rows = logs.select(
        F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
        F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"),
    )
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    same = F.lit(True)
    for c in ("turn", "role", "text"):
        same = same & F.col(c).eqNullSafe(F.lag(c).over(order))
    rows = rows.withColumn("again", same & (F.row_number().over(order) > 1)).filter(~F.col("again")).drop("again")
    rows = rows.withColumn("position", F.row_number().over(order))
    field = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.char_length(c).cast("string"), F.lit(":"), F.col(c)))
    digest = F.sha2(F.concat(F.col("position").cast("string"), F.lit("|"), field("role"), field("text")), 256)
    rows = rows.withColumn("digest", digest)
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.select(
        "conv_id", "position", "role", "text",
        F.bit_xor(_half(F.col("digest"), 1)).over(upto).alias("h1"), F.bit_xor(_half(F.col("digest"), 16)).over(upto).alias("h2"),
    )


def render(position: Column, role: Column, text: Column) -> Column:
    """Aggregate: the turns in order, each between marks that name its role."""
    turn = F.concat(F.lit(START), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(END + "\n"))
    parts = F.sort_array(F.collect_list(F.struct(position.alias("p"), turn.alias("t"))))
    return F.array_join(F.transform(parts, lambda x: x["t"]), "")


def collapse_and_render(logs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Maximal conversations: conv_id, n_turns, n_copies (equal conversations, itself included), text."""
    turns = turns_with_prefixes(logs, conv, turn, role, text)
    whole = turns.groupBy("conv_id").agg(
        F.max("position").alias("position"), F.max_by("h1", "position").alias("h1"), F.max_by("h2", "position").alias("h2"),
        render(F.col("position"), F.col("role"), F.col("text")).alias("text"),
    )
    key = ["position", "h1", "h2"]
    distinct = whole.groupBy(*key).agg(F.min(F.struct(F.col("conv_id").isNull().alias("n"), "conv_id"))["conv_id"].alias("conv_id"), F.count("*").alias("n_copies"))
    longest = F.max("position").over(W.partitionBy("conv_id"))
    prefixes = turns.select("conv_id", *key).withColumn("last", longest).filter("position < last").select(*key).distinct()
    maximal = distinct.join(prefixes, key, "left_anti").select(F.col("conv_id").alias("kept_id"), "n_copies")
    return whole.join(maximal, F.col("conv_id").eqNullSafe(F.col("kept_id"))).select(
        "conv_id", F.col("position").cast("bigint").alias("n_turns"), "n_copies", "text"
    )
