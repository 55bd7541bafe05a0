"""Behaviour of flows, routing, services, loops and machines on small streams."""

import pytest
from pyspark.sql import functions as F

from atomflow.functions import java_hash
from atomflow.operators import keyed, loops, machines, services
from atomflow.operators.actors import Context, run_actors
from atomflow.operators.flow import Factory, Flow
from atomflow.operators.routing import Sequencer, Splitter
from atomflow.plans.app import App, PlanError, Registry
from atomflow.sources import batch, from_list, from_lists, from_range


def values(df, *cols, order=("__atom", "__seq")):
    return [r[0] if len(cols) == 1 else tuple(r) for r in df.orderBy(*[c for c in order if c in df.columns]).select(*cols).collect()]


def test_steps_rotate_per_atom(spark):
    rows = Flow(from_lists(spark, [[0]] * 10))
    v = F.col("v")
    assert values(rows.steps("x", [(v + 1, 1), (v + 2, 1), (v + 3, 1), (v, 2)]).df, "x") == [1, 2, 3, 0, 0, 1, 2, 3, 0, 0]


def test_wrapper_replaces_small_values(spark):
    rows = Flow(from_lists(spark, [[1, 2, 3, 4]])).with_columns(x=F.col("v") + 5)
    out = rows.with_wrapper(lambda df, run: run(df).withColumn("x", F.when(F.col("v") < 3, 0).otherwise(F.col("x"))))
    assert values(out.df, "x") == [0, 0, 8, 9]


def test_and_then(spark):
    rows = Flow(from_lists(spark, [[0], [1], [2], [3]])).filter(F.col("v") >= 1)
    for n in (1, 2, 3):
        rows = rows.with_and_then(lambda df, n=n: df.withColumn("v", F.col("v") + n))
    assert values(rows.with_and_then(lambda df: df.filter("v < 9")).df, "v") == [7, 8]


def test_all_wrappers_run_every_operator_twice(spark):
    add = lambda n: lambda df: df.withColumn("v", F.col("v") + n)
    rows = Flow(from_lists(spark, [[1, 2, 3, 4]]))
    for n in (1, 1, 1):
        rows = rows.task(add(n))
    out = rows.all_with_wrapper(lambda df, run: run(run(df)))
    assert values(out.df, "v") == [7, 8, 9, 10]


def test_state_per_key_and_per_task(spark):
    rows = from_lists(spark, [[1, 2, 3], [1, 2, 3]])
    assert values(keyed.previous(rows, ["v"], "v", 0), "previous") == [0, 0, 0, 1, 2, 3]
    assert values(keyed.previous_by_atom(rows, "v", 0), "previous") == [0, 1, 2, 3, 1, 2]


def test_atom_hook_cumulates(spark):
    rows = from_lists(spark, [[1, 2, 3, 4], [1, 2, 3, 4]])
    assert values(keyed.cumulative_per_atom(rows, F.sum("v")), "total") == [10, 20]
    out = Flow(rows).with_on_atom_complete(cumulative=True, v=F.sum("v")).df.orderBy("__atom", "__seq", F.col("__end").isNotNull())
    assert [r.v for r in out.collect()] == [1, 2, 3, 4, 10, 1, 2, 3, 4, 20]


def test_all_atom_hooks(spark):
    add = lambda n: lambda df: df.withColumn("v", F.col("v") + n)
    rows = Flow(from_lists(spark, [[1, 2], [1, 2]]))
    for n in (1, 2, 3):
        rows = rows.task(add(n))
    out = rows.all_with_on_atom_complete(v=F.lit(0) * F.count("*")).df
    got = sorted(r.v for r in out.filter("__atom = 0").collect())
    assert got == [0, 3, 5, 7, 8]


def test_splitter_takes_first_match_and_split_all(spark):
    rows = from_list(spark, range(12))
    s = Splitter(rows).split("even", F.col("v") % 2 == 0).split("third", F.col("v") % 3 == 0)
    assert values(s.output("third"), "v") == [3, 9]
    even, third = Flow(rows).split(F.col("v") % 2 == 0, F.col("v") % 3 == 0)
    assert even.df.count() + third.df.count() == 6 + 4
    with pytest.raises(ValueError):
        s.split("even", F.lit(True))
    assert Splitter(rows).routed().count() == 0


def test_sequencer_keeps_order_within_inputs(spark):
    a, b = from_range(spark, 0, 10, 5), from_range(spark, 100, 110, 5)
    assert [r.v for r in Sequencer(a, b).in_order().collect()] == [*range(5), *range(100, 105), *range(5, 10), *range(105, 110)]
    assert [r.v for r in Sequencer(a, b, policy=Sequencer.ONE_AFTER_ANOTHER).in_order().collect()] == [*range(10), *range(100, 110)]


def test_empty_streams(spark):
    none = batch.empty(spark)
    assert keyed.running_count(none, ["v"]).count() == 0
    assert Flow(none).with_on_atom_complete(n=F.count("*")).df.count() == 0
    assert Flow(none).empty("a string, b double").df.schema["b"].dataType.simpleString() == "double"
    assert keyed.previous_by_atom(none, "v", 0).count() == 0


def test_expected_type(spark):
    rows = Flow(from_list(spark, [1]))
    rows.check_expected_type("v bigint")
    with pytest.raises(TypeError):
        rows.check_expected_type("v string")


def test_salted_sum_equals_plain(spark):
    rows = from_range(spark, 0, 1000, 37).withColumn("k", F.lit(1))
    one = keyed.running_sum(rows, ["k"], F.col("v")).select("v", "total")
    two = keyed.running_sum_salted(rows, ["k"], F.col("v")).select("v", "total")
    assert one.exceptAll(two).count() == 0 and two.count() == 1000


def test_results_do_not_depend_on_partitions(spark):
    rows = from_range(spark, 0, 500, 50).withColumn("k", F.col("v") % 3)
    one = sorted(map(tuple, keyed.running_count(rows, ["k"]).select("v", "n").collect()))
    two = sorted(map(tuple, keyed.running_count(rows.repartition(7, F.rand(1)), ["k"]).select("v", "n").collect()))
    assert one == two


def test_as_of_with_and_without_keys(spark):
    updates = from_lists(spark, [[1, 2], [3]]).withColumn("k", F.lit(0))
    asked = from_lists(spark, [[0], [0], [0]]).withColumn("k", F.lit(0))
    assert values(services.ask_as_of(asked, updates, "v"), "reply") == [3, 6, 6]
    assert values(services.ask_as_of(asked, updates, "v", keys=["k"]), "reply") == [3, 6, 6]
    assert values(services.ask_as_of(asked, updates, "v", running=None), "reply") == [2, 3, 3]


def test_recursion(spark):
    start = spark.createDataFrame([(1, 128)], "id int, v int")
    assert sorted(r.v for r in loops.countdown(spark, start, "v").collect()) == list(range(129))
    assert [r.fib for r in loops.fibonacci(spark, 9).orderBy("n").collect()] == [0, 1, 1, 2, 3, 5, 8, 13, 21, 34]


def test_recursion_has_no_row_cap(spark):
    start = spark.range(30).select("id", F.col("id").alias("v"))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        rows = loops.countdown(spark, start, "v")
        assert rows.count() == 465 and len(rows.filter("v = 0").collect()) == 30
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    big = loops.countdown(spark, spark.range(60_000).select("id", F.lit(19).alias("v")), "v")
    assert big.agg(F.count("*"), F.countDistinct("id"), F.sum("v")).first() == (1_200_000, 60_000, 60_000 * 190)


def test_two_state_machine(spark):
    def first(row, memory):
        return "second", [(row["v"], 0)]

    def second(row, memory):
        return "first", [(row["v"], 1)]

    rows = from_lists(spark, [[0], [1], [2]]).withColumn("k", F.lit(0))
    out = machines.machine(rows, ["k"], {"first": first, "second": second}, "first", "v bigint, s bigint").orderBy("v")
    assert [r.s for r in out.collect()] == [0, 1, 0]


def test_sagas_are_all_or_nothing(spark):
    ops = [(0, 1, 0, "deposit", 1, 10), (0, 2, 1, "withdraw", 1, 4), (0, 2, 2, "withdraw", 1, 8), (0, 3, 3, "withdraw", 1, 10)]
    out = machines.sagas(spark.createDataFrame(ops, "bank int, saga bigint, __seq bigint, kind string, account bigint, amount bigint"), ["bank"])
    assert sorted(map(tuple, out.collect())) == [(1, True), (2, False), (3, True)]


def test_registry_and_plan_checks(spark):
    registry = Registry(spark)
    with App("a", registry) as app:
        app.workflow(app.generator(from_list(spark, [1, 2])), lambda f: [f, f], "twice")
    assert registry.stream("/a/workflows/twice/stream").count() == 4
    assert spark.table(Registry.view("/a/workflows/twice/stream")).count() == 4
    with pytest.raises(PlanError):
        App("a", registry).launch()
    late = App("b", registry)
    late.service("nobody")
    with pytest.raises(PlanError):
        late.launch()
    with pytest.raises(PlanError):
        App("c", registry).refer("/a/nothing")
    with pytest.raises(PlanError):
        app.generator(from_list(spark, [1]))


def test_actors_stop_and_drop(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))

    def once(c: Context, m: dict) -> str:
        c.emit(m)
        return "stopped"

    out = run_actors(spark, {"once": once}, [(1, "once", {})], [(1, {"x": 1}), (1, {"x": 2})])
    assert [r.body for r in out.collect()] == ['{"x": 1}']


def test_java_hash(spark):
    row = spark.range(1).select(java_hash(F.lit("the")).alias("a"), java_hash(F.lit("Hello, World!")).alias("b")).first()
    assert (row.a, row.b) == (114801, 1498789909)


def test_factories_are_unwrapped(spark):
    add = Factory(lambda: Factory(lambda: lambda df: df.withColumn("v", F.col("v") + 1)))
    assert values(Flow(from_list(spark, [1, 2, 3])).init(add).df, "v") == [2, 3, 4]


def test_two_applications_play_ping_pong(spark, tmp_path):
    """Two applications answer each other through the registry until the count is down."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    registry = Registry(spark)
    for name in ("ping", "pong"):
        with App(name, registry) as app:
            app.service("hit").replier(lambda requests: requests.filter("i > 1").withColumn("i", F.col("i") - 1))

    def step(rows):
        back = registry.get("/pong/services/hit").ask(rows)
        forth = registry.get("/ping/services/hit").ask(back)
        return back.unionByName(forth), forth

    out = loops.until_empty(spark.createDataFrame([(8,)], "i bigint"), step)
    assert sorted((r.i for r in out.collect()), reverse=True) == [7, 6, 5, 4, 3, 2, 1]


def test_logger_counts_rows(spark, caplog):
    import time

    with caplog.at_level("INFO", logger="atomflow"):
        assert len(Flow(spark.range(7)).logger("ids: ").sink().collect()) == 7
        for _ in range(50):
            if "ids: 7 rows" in caplog.text:
                break
            time.sleep(0.1)
    assert "ids: 7 rows" in caplog.text
