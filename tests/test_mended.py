"""Cases in which rows or values once got lost: null keys, unions, message order, merged order, memory across atoms."""

import json
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atomflow.functions import hash_code
from atomflow.operators import keyed, loops, machines, services
from atomflow.operators.actors import Context, run_actors
from atomflow.operators.flow import Flow
from atomflow.operators.routing import Sequencer, at_random
from atomflow.sources import AtomFiles, GeneratorSource, from_list, from_lists, from_range
from atomflow.streaming import Runtime, run_atoms

ROWS = st.lists(st.tuples(st.sampled_from([None, "a", "b"]), st.one_of(st.none(), st.integers(-50, 50))), max_size=25)
SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def stream(spark, rows):
    return spark.createDataFrame([(k, v, i // 4 if i % 9 else None, i) for i, (k, v) in enumerate(rows)], "k string, v bigint, __atom bigint, __seq bigint")


@SLOW
@given(ROWS)
def test_split_forms_equal_plain_ones(spark, rows):
    df = stream(spark, rows)
    block = F.floor(F.col("__seq") / 3)
    plain = keyed.running_sum(keyed.running_count(df, ["k"]), ["k"], F.col("v"))
    plain = machines.reset_machine(keyed.previous(plain, ["k"], "v", -99), ["k"], F.when(F.col("v") > 0, F.col("v")), -7)
    values = {"n": ("sum", F.lit(1).cast("bigint")), "total": ("sum", F.col("v")), "low": ("min", F.col("v")), "high": ("max", F.col("v"))}
    split = keyed.running(df, values, ["k"], block=block)
    split = keyed.running(split, {"p": ("last", F.struct("v"))}, ["k"], exclusive=True, block=block).withColumn("previous", F.coalesce("p.v", F.lit(-99)))
    split = keyed.running(split, {"s": ("last", F.when(F.col("v") > 0, F.col("v")))}, ["k"], exclusive=True, block=block).withColumn("state", F.coalesce("s", F.lit(-7)))
    cols = ["__seq", "n", "total", "previous", "state"]
    got = sorted(map(tuple, split.select(*cols, "low", "high").collect()))
    assert [r[:5] for r in got] == sorted(map(tuple, plain.select(*cols).collect()))
    for i, (k, v) in enumerate(rows):
        upto = [x for q, x in rows[: i + 1] if q == k and x is not None]
        assert got[i][5:] == (min(upto, default=None), max(upto, default=None))


def test_sums_keep_null_keys_and_leading_nulls(spark):
    rows = [("a", 1), (None, 2), ("a", None), (None, None), ("a", None), (None, 5), ("a", 3)]
    df = spark.createDataFrame([(k, v, i // 2, i) for i, (k, v) in enumerate(rows)], "k string, v bigint, __atom bigint, __seq bigint")
    out = keyed.running_sum_salted(df, ["k"], F.col("v")).orderBy("__seq").collect()
    assert [r.total for r in out] == [1, 2, 1, 2, 1, 7, 4]


def test_null_atoms_stay(spark):
    df = spark.createDataFrame([(1, None, 0), (2, 0, 1), (3, 1, 2)], "v bigint, __atom bigint, __seq bigint")
    assert [r.previous for r in keyed.previous_by_atom(df, "v", 0).orderBy("__seq").collect()] == [0, 1, 2]
    asked = services.ask_as_of(df, df, "v").orderBy("__seq").collect()
    assert [r.reply for r in asked] == [1, 3, 6]


def test_hooks_behind_unions_and_on_sources(spark):
    rows = Flow(from_lists(spark, [[1, 2], [3]]))
    add = lambda n: lambda df: df.withColumn("v", F.col("v") + n)
    got = lambda flow: sorted(r.v for r in flow.df.collect())
    both = rows.task(add(10)).union(rows.task(add(20)))
    assert got(both.with_on_next(add(100))) == [111, 112, 113, 121, 122, 123]
    assert got(both.with_wrapper(lambda df, run: run(df).filter("v <> 12"))) == [11, 13, 21, 22, 23]
    assert got(both.with_and_then(add(1))) == [12, 13, 14, 22, 23, 24]
    assert got(rows.with_on_next(add(5))) == [6, 7, 8] and got(rows.with_wrapper(lambda df, run: run(df))) == [1, 2, 3]
    # Both maps and the union run twice.
    twice = rows.task(add(10)).union(rows.task(add(20))).task(add(1)).all_with_wrapper(lambda df, run: run(run(df)))
    assert got(twice) == [23, 24, 25, 43, 44, 45]
    ends = rows.task(add(10)).union(rows.task(add(20))).all_with_on_atom_complete(v=F.lit(0) * F.count("*")).df
    assert sorted(r.v for r in ends.filter("__atom = 1").collect()) == [0, 0, 0, 13, 23]


def test_cumulative_hooks_merge_as_the_aggregate_does(spark):
    rows = Flow(from_lists(spark, [[5, 2], [3], [4, 9]]))
    ends = lambda **k: [r.v for r in rows.with_on_atom_complete(**k).df.filter("__end").orderBy("__atom").collect()]
    assert ends(cumulative=True, v=F.max("v")) == [5, 5, 9] and ends(cumulative=True, v=F.min("v")) == [2, 2, 2] and ends(cumulative=True, v=F.count("*")) == [2, 3, 5]
    assert ends(v=F.avg("v").cast("bigint")) == [3, 3, 6] and ends(cumulative={"v": "last"}, v=F.max_by("v", "__seq")) == [2, 3, 9]
    with pytest.raises(ValueError):
        ends(cumulative=True, v=F.avg("v"))
    assert [r.total for r in keyed.cumulative_per_atom(rows.df, F.max("v"), merge="max").orderBy("__atom").collect()] == [5, 5, 9]


def test_empty_atoms_end_too(spark):
    atoms = spark.range(4).withColumnRenamed("id", "__atom")
    out = Flow(from_lists(spark, [[1, 2], [], [3]])).with_on_atom_complete(atoms=atoms, n=F.count("*"), s=F.sum("v"), cumulative={"s": "sum"}).df.filter("__end")
    assert [(r.n, r.s) for r in out.orderBy("__atom").collect()] == [(2, 3), (0, 3), (1, 6), (0, 6)]


def test_only_failures_fall_back(spark):
    rows = Flow(spark.createDataFrame([("1",), ("x",), (None,)], "t string"))
    out = rows.with_on_error("v", F.col("t").try_cast("int"), F.lit(-1), F.col("t")).df
    assert [(r.t, r.v) for r in out.collect()] == [("1", 1), ("x", -1), (None, None)]


def test_messages_arrive_in_the_order_in_which_they_were_sent(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))

    def forward(c: Context, m: dict) -> None:
        c.send(2, {"x": m["x"]})
        c.send(2, {"x": -m["x"]})

    def collect(c: Context, m: dict) -> str | None:
        c.map("seen").set(str(m["x"]), True)
        order = c.value("order", [])
        order.set([*order.get(), m["x"]])
        if len(order.get()) == 6:
            c.emit({"order": order.get()})
            return "stopped"
        return None

    counts: dict = {}
    sent = [(1, {"x": x}) for x in (3, 2, 1)]
    out = run_actors(spark, {"forward": forward, "collect": collect}, [(1, "forward", {}), (2, "collect", {})], sent, counts=counts)
    assert [r.body for r in out.collect()] == ['{"order": [3, -3, 2, -2, 1, -1]}'] and counts["dropped"] == 0 and counts["messages"] == 9


def test_actors_start_once_and_dropped_messages_are_counted(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))

    def parent(c: Context, m: dict) -> str:
        child = c.create("child", {"n": 5})
        c.send(child, {"add": 1})
        c.send(child, {"add": 2})
        return "stopped"

    def start(c: Context) -> None:
        c.value("n").set(c.value("n").get() * 10)

    def child(c: Context, m: dict) -> str:
        c.emit({"n": c.value("n").get() + m["add"]})
        return "stopped"

    counts: dict = {}
    out = run_actors(spark, {"parent": parent, "child": child}, [(1, "parent", {})], [(1, {}), (1, {})], starts={"child": start}, counts=counts)
    assert [r.body for r in out.collect()] == ['{"n": 51}'] and counts["dropped"] == 2


def test_merged_order_does_not_depend_on_partitions(spark):
    a, b = from_range(spark, 0, 10, 5), from_range(spark, 100, 107, 5)
    for policy in (Sequencer.ROUND_ROBIN, Sequencer.ONE_AFTER_ANOTHER, at_random(3)):
        one = Sequencer(a, b, policy=policy).numbered()
        two = Sequencer(a.repartition(7, F.rand(1)), b.repartition(3, F.rand(2)), policy=policy).numbered()
        rows = one.orderBy("__seq").collect()
        assert rows == two.orderBy("__seq").collect() and [r["__seq"] for r in rows] == list(range(17))
        assert [r.v for r in rows] == [r.v for r in Sequencer(a, b, policy=policy).in_order().collect()]
        assert [r.v for r in rows if r.v < 100] == list(range(10)) and [r.v for r in rows if r.v >= 100] == list(range(100, 107))
        assert sorted({r["__atom"] for r in rows}) == [0, 1, 2, 3]
    counted = keyed.running_count(Sequencer(a, b).numbered().withColumn("k", F.lit(1)), ["k"]).orderBy("n").collect()
    assert [r.v for r in counted] == [*range(5), *range(100, 105), *range(5, 10), 105, 106]


def test_random_policies_differ(spark):
    a, b = from_range(spark, 0, 100, 5), from_range(spark, 100, 200, 5)
    orders = {tuple(r.v for r in Sequencer(a, b, policy=at_random(s)).in_order().collect()) for s in range(4)}
    assert len(orders) == 4


def test_keys_of_values_and_contextual_keys(spark):
    assert [hash_code(x) for x in ("the", "Hello, World!", 7, -1, 2**40, True, 1.5, None, [1])] == [114801, 1498789909, 7, -1, 256, 1231, 1073217536, None, None]
    assert [r["__key"] for r in from_list(spark, ["a", "b"], "string").collect()] == [97, 98]
    rows = Flow(from_list(spark, range(6))).key(F.col("v") % 2).ranges(3)
    assert sorted((r.v, r.n) for r in keyed.running_count(rows.df, None).collect()) == [(0, 1), (1, 1), (2, 2), (3, 2), (4, 3), (5, 3)]


def test_tree_of_requests(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    n = F.col("n")
    start = spark.createDataFrame([(i, i) for i in range(10)], "id bigint, n bigint")
    out = loops.ask_tree(start, ["id"], n < 2, n, F.array(F.struct((n - 1).alias("n")), F.struct((n - 2).alias("n"))), lambda r: F.sum(r))
    assert [r.reply for r in out.orderBy("id").collect()] == [0, 1, 1, 2, 3, 5, 8, 13, 21, 34]
    assert {r.id: r.calls for r in out.collect()}[9] == 109
    assert loops.ask_tree(start.limit(0), ["id"], n < 2, n, F.array(F.struct((n - 1).alias("n"))), lambda r: F.sum(r)).count() == 0
    with pytest.raises(RuntimeError):
        loops.ask_tree(start, ["id"], n < 0, n, F.array(F.struct("n")), lambda r: F.sum(r), levels=3)


def test_fold_keeps_null_keys_and_long_keys_apart(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2]), i) for i in range(25_000)]
    df = spark.createDataFrame(rows, "k bigint, __seq bigint").repartition(6)
    out = machines.fold_sorted(df, ["k"], ["__seq"], lambda: 0, lambda n, r: (n + 1, [(r["k"], r["__seq"], n + 1)]), "k bigint, i bigint, n bigint")
    seen = {}
    want = [(k, i, seen.setdefault(k, []).append(1) or len(seen[k])) for k, i in rows]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def purse():
    def on_event(row, memory):
        memory["sum"] = memory.get("sum", 0) + (row["v"] or 0)

    def on_request(row, memory):
        memory["asked"] = memory.get("asked", 0) + 1
        return [(row["k"], row["__seq"], memory.get("sum", 0), memory["asked"])]

    return on_event, on_request, "k bigint, seq bigint, total bigint, asked bigint"


def stashing():
    def handle(row, memory, stash):
        if row["v"] is None or row["v"] == 0:
            return "open", [(row["k"], -1, stash.size()), *stash.unstash_all()] if not memory.get("open") else []
        if memory.get("first") is None:
            memory["first"] = row["v"]
        if stash.size() < 3 and "again" not in row:
            stash.stash({**row, "again": 1})
            return "open", []
        return "open", [(row["k"], row["v"], stash.size())]

    return handle


def test_streams_and_batches_give_the_same_replies(spark, tmp_path):
    rng = random.Random(8)
    atoms = [[(rng.randrange(3), rng.choice([0, 0, 5, None, 2**60 + rng.randrange(9)]), rng.random() < 0.5) for _ in range(rng.randint(1, 9))] for _ in range(4)]
    source = AtomFiles(spark, str(tmp_path / "in"), "k bigint, v bigint, asks boolean")
    for atom in atoms:
        for row in atom:
            source.submit(*row)
        source.fuse()
    whole = spark.read.parquet(str(tmp_path / "in")).drop("__error")
    parts = lambda df: (df.filter("not asks"), df.filter("asks").drop("v"))
    on_event, on_request, schema = purse()
    want = sorted(map(tuple, machines.serve(*parts(whole), ["k"], on_event, on_request, schema).collect()))
    got: list = []
    run_atoms(machines.serve(*parts(source.read()), ["k"], on_event, on_request, schema), lambda df, n: got.extend(map(tuple, df.collect())), str(tmp_path / "c1"))
    assert sorted(got) == want and len(want) == sum(a for atom in atoms for _, _, a in atom)

    form = lambda df: machines.machine(df, ["k"], {"open": stashing()}, "open", "k bigint, v bigint, n bigint", stash=True)
    want, got = sorted(map(tuple, form(whole).collect())), []
    run_atoms(form(source.read()), lambda df, n: got.extend(map(tuple, df.collect())), str(tmp_path / "c2"))
    assert sorted(got) == want and want


def test_stash_replays_in_order(spark):
    rows = from_lists(spark, [[5, 6], [7, 0, 8]]).withColumn("k", F.lit(1).cast("bigint"))

    def gate(row, memory, stash):
        if row["v"] == 0:
            memory["n"] = 1
            return "gate", [(stash.size(),), *stash.unstash_all()]
        if memory["n"]:
            return "gate", [(row["v"],)]
        stash.stash(row)
        return "gate", []

    out = machines.machine(rows, ["k"], {"gate": gate}, "gate", "v bigint", stash=True)
    assert [r.v for r in out.collect()] == [3, 5, 6, 7, 8]


def test_external_errors_reach_the_reader(spark, tmp_path):
    source = AtomFiles(spark, str(tmp_path / "in"), "v bigint")
    source.submit(1)
    source.fuse()
    source.submit(2)
    source.error("the pump broke")
    seen: list = []
    with pytest.raises(Exception, match="the pump broke"):
        run_atoms(source.read(), lambda df, n: seen.extend(r.v for r in df.collect()), str(tmp_path / "check"))
    assert seen == [1]
    with pytest.raises(ValueError):
        source.submit(3)


def test_late_readers_start_at_the_latest_atom(spark, tmp_path):
    source = AtomFiles(spark, str(tmp_path / "in"), "v bigint")
    source.submit(1)
    source.fuse()
    late = source.read(latest=True)
    source.submit(2)
    source.seal()
    seen: dict = {"all": [], "late": []}
    for name, df in (("all", source.read()), ("late", late)):
        run_atoms(df, lambda rows, n, to=seen[name]: to.extend(r.v for r in rows.collect()), str(tmp_path / name))
    assert seen == {"all": [1, 2], "late": [2]}


def test_generators_are_throttled_and_stepped(spark, tmp_path):
    import time

    source = GeneratorSource(spark, "v int", lambda atom: [(5 * atom + i,) for i in range(5)] if atom < 3 else None, per_second=5)
    seen: list = []
    runtime = Runtime(spark)
    runtime.launch(source.read(), lambda df, n: seen.extend((r.v, time.monotonic()) for r in df.collect()), str(tmp_path / "check"))
    assert runtime.step()
    end = time.monotonic() + 30
    while len(seen) < 15 and time.monotonic() < end:
        time.sleep(0.05)
    runtime.step_for(0.2)
    runtime.shutdown()
    assert [v for v, _ in seen] == list(range(15)) and seen[-1][1] - seen[0][1] >= 1.0 and not runtime.can_step()


def test_routing_and_hooks_in_streams(spark, tmp_path):
    from atomflow.operators.routing import Splitter

    source = AtomFiles(spark, str(tmp_path / "in"), "v bigint")
    for atom in ([1, 2, 3], [4], [6, 9]):
        for v in atom:
            source.submit(v)
        source.fuse()
    whole = spark.read.parquet(str(tmp_path / "in")).drop("__error")

    def form(df):
        routes = Splitter(df).split("even", F.col("v") % 2 == 0).split("third", F.col("v") % 3 == 0)
        both = Sequencer(routes.output("even"), routes.output("third")).merged()
        return Flow(both).with_columns(x=F.col("v") + 1).with_wrapper(lambda df, run: run(df).withColumn("x", F.col("x") * 2)).df.select("v", "x", "__input", "__atom")

    got: list = []
    run_atoms(form(source.read()), lambda df, n: got.extend(map(tuple, df.collect())), str(tmp_path / "check"))
    assert sorted(got) == sorted(map(tuple, form(whole).collect())) and len(got) == 5


def test_systems():
    from atomflow.streaming import systems

    assert systems.default().version and systems.parallel(2) is not None and systems.test() is not None


def test_actors_are_dealt_over_all_cores(spark, monkeypatch):
    """Messages of few bytes aren't merged into one task: behaviours of a round run in as many tasks as there are cores."""
    from atomflow.operators import actors

    monkeypatch.setattr(actors, "GROUP", 100)

    def where(c, m):
        from pyspark import TaskContext

        c.emit({"part": TaskContext.get().partitionId(), "n": m["n"]})

    n = 2000
    out = actors.run_actors(spark, {"where": where}, [(i, "where", {}) for i in range(n)], [(i, {"n": i}) for i in range(n)]).collect()
    rows = [json.loads(r["body"]) for r in out]
    assert sorted(r["n"] for r in rows) == list(range(n))
    sizes = Counter(r["part"] for r in rows)
    assert len(sizes) >= 15 and max(sizes.values()) < 600
