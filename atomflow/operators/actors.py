"""Actors over dataflows: messages are rows, behaviours are registered by name, rounds run until no message is left.

Each round delivers all messages at once: they are dealt with their actors' states into even tasks of some thousand messages, as many as there are cores at least, and the
behaviour of each actor folds its messages in order and gives a new state and new messages. An actor gets its messages by
(round in which they were sent, sender, the sender's running number), so what one actor sends to another arrives in the order in which it was sent. A
new actor's id is a hash of its creator's id and an ordinal, so reruns give the same ids.
"""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("atomflow")
STOPPED = "stopped"
#: Messages that one task handles, about.
GROUP = 20_000
#: Groups of actors in a task, so that tasks are even.
GROUPS = 4
#: Rounds after which changed states are merged into the table of all states.
COMPACT = 8
#: Sender of the first messages and of the message that starts a new actor, which comes before all others.
OUTSIDE = -1
_START = "__start"
_STEP = "kind string, target bigint, round int, sender bigint, seq bigint, body string, behaviour string, memory string"
_ARROW = pa.schema([(c, {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[t]) for c, t in map(str.split, _STEP.split(", "))])
_dumps = json.JSONEncoder(sort_keys=True).encode


@dataclass
class Value:
    """A typed field of an actor's state."""

    memory: dict
    name: str
    default: object = None

    def get(self):
        return self.memory.get(self.name, self.default)

    def set(self, value) -> None:
        self.memory[self.name] = value


@dataclass
class MapState:
    """A field of an actor's state that holds values by text keys."""

    memory: dict
    name: str

    def get(self, key: str, default=None):
        return self.memory.get(self.name, {}).get(key, default)

    def set(self, key: str, value) -> None:
        self.memory.setdefault(self.name, {})[key] = value

    def remove(self, key: str) -> None:
        self.memory.get(self.name, {}).pop(key, None)


@dataclass
class Context:
    """What a behaviour can do while it handles a message. memory is the raw state; value and map are typed fields of it."""

    self_id: int
    memory: dict
    made: int = 0
    sent: list[tuple[int, dict]] = field(default_factory=list)
    created: list[tuple[int, str, dict]] = field(default_factory=list)
    out: list[dict] = field(default_factory=list)

    def send(self, target: int, body: dict) -> None:
        self.sent.append((target, body))

    def create(self, behaviour: str, memory: dict | None = None) -> int:
        """A new actor, which gets messages from the next round on."""
        self.made += 1
        digest = hashlib.sha256(f"{self.self_id}/{self.memory.get('_made', 0) + self.made}".encode()).digest()
        ref = int.from_bytes(digest[:8], "big") >> 1
        self.created.append((ref, behaviour, memory or {}))
        return ref

    def emit(self, body: dict) -> None:
        self.out.append(body)

    def value(self, name: str, default=None) -> Value:
        return Value(self.memory, name, default)

    def map(self, name: str) -> MapState:
        return MapState(self.memory, name)

    def log(self, text: str) -> None:
        log.info("actor %d: %s", self.self_id, text)


#: A behaviour handles one message and returns the name of the next behaviour, or None to stay the same.
Behaviour = Callable[[Context, dict], str | None]


def _deliver(behaviours: dict[str, Behaviour], starts: dict[str, Callable[[Context], str | None]], turn: int):
    def handled(target: int, behaviour: str, memory: dict, bodies: list[str]) -> list[tuple]:
        out: list[tuple] = []
        number = 0
        for nr, body in enumerate(bodies):
            if behaviour == STOPPED:
                out.append(("dropped", target, turn, None, nr, body, None, None))
                continue
            c, message = Context(target, memory), json.loads(body)
            behaviour = (starts[behaviour](c) if _START in message else behaviours[behaviour](c, message)) or behaviour
            memory["_made"] = memory.get("_made", 0) + c.made
            for to, b in c.sent:
                out.append(("message", to, turn, target, number, _dumps(b), None, None))
                number += 1
            for ref, name, own in c.created:
                out.append(("state", ref, turn, None, None, None, name, json.dumps(own)))
                if name in starts:
                    out.append(("message", ref, turn, OUTSIDE, 0, _dumps({_START: True}), None, None))
            out += [("out", target, turn, None, None, _dumps(b), None, None) for b in c.out]
        out.append(("state", target, turn, None, None, None, behaviour, json.dumps(memory)))
        return out

    def fold(key, messages: pa.Table, states: pa.Table) -> pa.Table:
        known = {t: (b, m) for t, b, m in zip(*(states[c].to_pylist() for c in ("target", "behaviour", "memory")), strict=True)}
        order = ("target", "round", "sender", "seq")
        messages = messages.sort_by([(c, "ascending") for c in order])
        out: list[tuple] = []
        cols = [messages[c].to_pylist() for c in (*order, "body")]
        at, n = 0, len(messages)
        while at < n:
            target, end = cols[0][at], at
            while end < n and cols[0][end] == target:
                end += 1
            if target in known:
                behaviour, memory = known[target]
                out += handled(target, behaviour, json.loads(memory), cols[4][at:end])
            else:  # not created yet: the messages wait for the next round
                out += [("message", target, r, s, q, b, None, None) for r, s, q, b in zip(*(c[at:end] for c in cols[1:]), strict=True)]
            at = end
        made = list(zip(*out, strict=True)) or [()] * len(_ARROW)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(made, _ARROW.types, strict=True)], schema=_ARROW)

    return fold


def run_actors(
    spark: SparkSession, behaviours: dict[str, Behaviour], actors: DataFrame | list[tuple[int, str, dict]], messages: DataFrame | list[tuple[int, dict]],
    rounds: int = 1000, starts: dict[str, Callable[[Context], str | None]] | None = None, counts: dict[str, int] | None = None,
) -> DataFrame:
    """Runs actors until no message is left; returns what they emitted as (target, body).

    actors and messages are lists, or tables (target, behaviour, memory) and (target, seq, body) with memories and bodies as JSON, whose
    seq orders the messages of an actor. starts: what a behaviour does once, when an actor with it is created by another one, before its first
    message. Messages to an actor that doesn't exist yet wait for it; if only such messages are left, the run fails. Messages to a
    stopped actor are dropped; counts, if given, gets their number, that of the rounds and of the messages handled.

    Only the states of actors that got messages are read and written in a round; every COMPACT rounds they are merged into the table of all.
    """
    starts, counts = starts or {}, {} if counts is None else counts
    counts.update(dropped=0, rounds=0, messages=0)
    if not isinstance(actors, DataFrame):
        actors = spark.createDataFrame([(r, b, json.dumps(m)) for r, b, m in actors], "target bigint, behaviour string, memory string")
    if not isinstance(messages, DataFrame):
        messages = spark.createDataFrame([(t, i, json.dumps(b, sort_keys=True)) for i, (t, b) in enumerate(messages)], "target bigint, seq bigint, body string")
    states = actors.select("target", "behaviour", "memory", F.lit(-1).alias("round")).checkpoint()
    queue = messages.select("target", F.lit(-1).alias("round"), F.lit(OUTSIDE).cast("bigint").alias("sender"), "seq", "body").checkpoint()
    left = queue.count()
    least = spark.sparkContext.defaultParallelism
    outputs: list[DataFrame] = []
    latest = F.max_by(F.struct("behaviour", "memory"), "round").alias("s")
    for turn in range(rounds):
        if not left:
            break
        # A given number of partitions: Spark would merge those of few bytes into a few tasks, though behaviours take long.
        tasks = max(least, -(-left // GROUP))
        group = F.pmod(F.xxhash64("target"), F.lit(GROUPS * tasks))
        dealt = lambda df, n=tasks, g=group: df.withColumn("__group", g).repartition(n, "__group").groupBy("__group")
        asked = states.join(queue.select("target").distinct(), "target", "left_semi").groupBy("target").agg(latest).select(F.col("target").alias("target"), "s.*")
        step = dealt(queue).cogroup(dealt(asked)).applyInArrow(_deliver(behaviours, starts, turn), _STEP).checkpoint()
        found = {r["kind"]: r["count"] for r in step.groupBy("kind").count().collect()}  # five kinds at most
        if not found.get("state"):
            raise RuntimeError("messages are left for actors that nobody created")
        states = states.unionByName(step.filter("kind = 'state'").select("target", "behaviour", "memory", "round"))
        if turn % COMPACT == COMPACT - 1:
            states = states.groupBy("target").agg(latest, F.max("round").alias("round")).select("target", "s.*", "round").checkpoint()
        if found.get("out"):
            outputs.append(step.filter("kind = 'out'").select("target", "body"))
        queue = step.filter("kind = 'message'").select("target", "round", "sender", "seq", "body")
        counts["messages"] += left
        counts["dropped"] += found.get("dropped", 0)
        counts["rounds"] += 1
        left = found.get("message", 0)
    else:
        raise RuntimeError(f"messages were left after {rounds} rounds")
    if counts["dropped"]:
        log.warning("%d messages to stopped actors were dropped", counts["dropped"])
    total = spark.createDataFrame([], "target bigint, body string")
    for o in outputs:
        total = total.unionByName(o)
    return total


def field_of(body: str, name: str, kind: str = "bigint"):
    """A field of a message's body as a column."""
    return F.get_json_object(body, f"$.{name}").cast(kind)
