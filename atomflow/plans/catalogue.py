"""The query catalogue: name -> query, and the SQL that gives the same rows.

``events`` is the stream of most queries: event_id is its order, and 100 events make an atom.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomflow.functions import cents, java_hash
from atomflow.operators import keyed, loops, machines, services
from atomflow.operators.actors import Context, field_of, run_actors
from atomflow.operators.flow import Flow
from atomflow.operators.routing import Sequencer, Splitter
from atomflow.plans.app import App, Registry
from atomflow.sources import batch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ATOM = 100


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.with_atoms(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", ATOM, "user_id")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT v // 16 AS atom, count(*) AS n, sum(v)::BIGINT AS total FROM range(0, 100000) t(v) GROUP BY 1")
def q_from_range(spark, sf_dir):
    """A range in atoms of 16, counted per atom."""
    return batch.from_range(spark, 0, 100_000, 16).groupBy(F.col("__atom").alias("atom")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT), (0, 2), (1, 3), (3, 4)) t(atom, v)")
def q_from_lists(spark, sf_dir):
    """Lists of lists as atoms; an empty list is an empty atom."""
    return batch.from_lists(spark, [[1, 2], [3], [], [4]]).select(F.col("__atom").alias("atom"), "v")


@query("SELECT * FROM (VALUES (0::BIGINT, 7::BIGINT, 1::BIGINT), (0, 7, 2), (1, 8, 3)) t(atom, k, v)")
def q_from_lists_keyed(spark, sf_dir):
    """Explicit keys; a pair of lists ends with the shorter one."""
    rows = batch.from_lists(spark, [[1, 2, 9], [3]], keys=[[7, 7], [8, 8]])
    return rows.select(F.col("__atom").alias("atom"), F.col("__key").alias("k"), "v")


@query("SELECT 42::BIGINT AS v")
def q_signal_empty(spark, sf_dir):
    """A signal, an empty stream and a stream that is consumed, united."""
    one = Flow(batch.signal(spark, 42))
    return one.union(Flow(batch.empty(spark)), one.nothing()).df.select("v")


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) * 2 + l_linenumber AS x FROM lineitem")
def q_map(spark, sf_dir):
    """One row in, one row out."""
    rows = Flow(_table(spark, sf_dir, "lineitem"))
    return rows.map(l_orderkey=F.col("l_orderkey"), l_linenumber=F.col("l_linenumber"), x=cents(F.col("l_extendedprice")) * 2 + F.col("l_linenumber")).df


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(trim(lower(text)), '[ \\n]+')) AS w FROM documents) WHERE w <> '' GROUP BY w".replace("\\\\", "\\"))
def q_flatmap_words(spark, sf_dir):
    """Words of all documents, counted."""
    words = Flow(_table(spark, sf_dir, "documents")).flat_map("word", F.split(F.trim(F.lower("text")), "[ \n]+"))
    return words.filter(F.col("word") != "").df.groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type, props FROM events WHERE contains(props, '9')")
def q_filter(spark, sf_dir):
    """Events whose properties hold a substring."""
    return Flow(_table(spark, sf_dir, "events")).filter(F.col("props").contains("9")).df.select("event_id", "event_type", "props")


@query("SELECT event_id, user_id FROM events")
def q_identity_named(spark, sf_dir):
    """Pass-through with a name, an expected type, a logger, a factory and a prebuilt task."""
    flow = Flow(_events(spark, sf_dir)).identity().with_name("same").logger("events: ")
    flow = flow.init(lambda: lambda df: df).task(lambda df: df.select("event_id", "user_id"))
    return flow.check_expected_type("event_id bigint, user_id bigint").df


@query("SELECT event_id, event_id + d AS x FROM events, (VALUES (1), (2), (3)) t(d)")
def q_union_diamond(spark, sf_dir):
    """One flow into three maps, united."""
    rows = Flow(_table(spark, sf_dir, "events").select("event_id"))
    a, b, c = (rows.with_columns(x=F.col("event_id") + d) for d in (1, 2, 3))
    return a.union(b, c).df


@query("SELECT event_id, event_id * 10 AS x FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_id * 10 FROM events WHERE event_id % 3 = 0")
def q_combine_all_from(spark, sf_dir):
    """Flows united under one task."""
    rows = Flow(_table(spark, sf_dir, "events").select("event_id"))
    even, third = rows.split(F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0)
    return even.combine_all_from([third], lambda df: df.withColumn("x", F.col("event_id") * 10)).df


@query("SELECT event_id, 'even' AS side FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'third' FROM events WHERE event_id % 3 = 0")
def q_split_independent(spark, sf_dir):
    """Two independent predicates: rows may go both ways or none."""
    rows = Flow(_table(spark, sf_dir, "events").select("event_id"))
    even, third = rows.split(F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0)
    return even.with_columns(side=F.lit("even")).union(third.with_columns(side=F.lit("third"))).df


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'even' WHEN event_id % 3 = 0 THEN 'third' END AS route FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0")
def q_splitter_first_match(spark, sf_dir):
    """The first route that matches takes the row; others are dropped."""
    s = Splitter(_table(spark, sf_dir, "events").select("event_id"))
    s.split("even", F.col("event_id") % 2 == 0).split("third", F.col("event_id") % 3 == 0).split("gone", F.lit(True)).remove("gone")
    return s.routed()


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END AS input, event_id // 100 AS atom FROM events WHERE event_type IN ('view', 'click', 'purchase')")
def q_sequencer_merge(spark, sf_dir):
    """Two streams merged by a sequencer, the second connected later."""
    events = _events(spark, sf_dir)
    s = Sequencer(events.filter(F.col("event_type").isin("view", "click"))).connect(events.filter("event_type = 'purchase'"))
    return s.merged().select("event_id", F.col("__input").alias("input"), F.col("__atom").alias("atom"))


@query(
    """SELECT event_id, user_id, n FROM (
         SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 1"""
)
def q_key_running_count(spark, sf_dir):
    """Running count of events per user, in stream order."""
    counted = keyed.running_count(_events(spark, sf_dir).select("event_id", "user_id", "__seq"), ["user_id"])
    return counted.filter("n > 1").drop("__seq")


@query("SELECT event_id, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS total FROM events")
def q_key_running_sum(spark, sf_dir):
    """Running sum per user, in hundredths."""
    rows = _events(spark, sf_dir).select("event_id", "user_id", "value", "__seq")
    return keyed.running_sum(rows, ["user_id"], cents(F.col("value"))).select("event_id", "total")


@query("SELECT event_id, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY event_id)::BIGINT AS total FROM events")
def q_running_sum_hot_keys(spark, sf_dir):
    """Running sum over five keys that hold all rows: sums per atom first."""
    rows = _events(spark, sf_dir).select("event_id", "event_type", "value", "__seq", "__atom")
    return keyed.running_sum_salted(rows, ["event_type"], cents(F.col("value"))).select("event_id", "total")


@query("SELECT event_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), 'none') AS previous FROM events")
def q_prev_per_key(spark, sf_dir):
    """The user's event before."""
    return keyed.previous(_events(spark, sf_dir), ["user_id"], "event_type", "none").select("event_id", "previous")


@query("SELECT event_id, coalesce(lag(event_type) OVER (ORDER BY event_id), 'none') AS previous FROM events")
def q_prev_per_task(spark, sf_dir):
    """The event before, over the whole operator."""
    return keyed.previous_by_atom(_events(spark, sf_dir), "event_type", "none").select("event_id", "previous")


@query("SELECT doc_id // 100 AS atom, w AS word, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '' GROUP BY 1, 2")
def q_wordcount_atom(spark, sf_dir):
    """Words counted per atom of 100 documents, then reset."""
    docs = batch.with_atoms(_table(spark, sf_dir, "documents"), "doc_id", 100)
    words = Flow(docs).flat_map("word", F.split("text", " ")).filter(F.col("word") != "")
    return keyed.count_per_atom(words.df, ["word"]).withColumnRenamed("__atom", "atom")


@query("SELECT event_id // 100 AS atom, sum(count(*)) OVER (ORDER BY event_id // 100)::BIGINT AS total FROM events WHERE event_type = 'purchase' GROUP BY 1")
def q_atom_cumulative(spark, sf_dir):
    """Purchases up to the end of each atom."""
    rows = _events(spark, sf_dir).filter("event_type = 'purchase'")
    return keyed.cumulative_per_atom(rows, F.count("*")).withColumnRenamed("__atom", "atom")


@query("SELECT event_id, NULL::BIGINT AS n FROM events UNION ALL SELECT NULL, count(*) FROM events GROUP BY event_id // 100")
def q_on_atom_complete(spark, sf_dir):
    """Rows, and behind those of each atom their number."""
    return Flow(_events(spark, sf_dir).select("event_id", "__atom", "__seq")).with_on_atom_complete(n=F.count("*")).df.select("event_id", "n")


@query("SELECT event_id, NULL::BIGINT AS total FROM events UNION ALL SELECT NULL, sum(event_id)::BIGINT FROM events")
def q_on_complete(spark, sf_dir):
    """Rows, and behind all of them one total."""
    return Flow(_events(spark, sf_dir).select("event_id", "__atom", "__seq")).with_on_complete(total=F.sum("event_id")).df.select("event_id", "total")


@query("SELECT event_id, CAST(event_type = 'purchase' AS INTEGER) * (event_id % 7) AS x, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def q_on_error(spark, sf_dir):
    """Values that may fail have a fallback; the latest handler is replaced by another."""
    rows = Flow(_events(spark, sf_dir)).with_columns(x=F.lit(0))
    rows = rows.with_on_next(lambda df: df.withColumn("x", F.when(F.col("event_type") == "purchase", F.col("event_id") % 7).otherwise(0)))
    rows = rows.with_on_error("k", F.get_json_object("props", "$.k").try_cast("int"), F.lit(None).cast("int"), F.col("props"))
    return rows.df.select("event_id", "x", "k")


@query("SELECT event_id, CASE WHEN value < 10 THEN 0 ELSE event_id + 5 END AS x FROM events")
def q_wrapper(spark, sf_dir):
    """Around advice: small values give 0, others run the operator."""
    rows = Flow(_table(spark, sf_dir, "events")).with_columns(x=F.col("event_id") + 5)
    small = F.col("value") < 10
    out = rows.with_wrapper(lambda df, run: run(df).withColumn("x", F.when(small, F.lit(0)).otherwise(F.col("x"))))
    return out.df.select("event_id", F.col("x").cast("bigint").alias("x"))


@query("SELECT event_id, event_id % 1000 + 6 AS x FROM events WHERE event_id % 1000 >= 1 AND event_id % 1000 + 6 < 900")
def q_and_then(spark, sf_dir):
    """A fused chain of filters and maps."""
    add = lambda n: lambda df: df.withColumn("x", F.col("x") + n)
    rows = Flow(_table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 1000).alias("x"))).filter(F.col("x") >= 1)
    return rows.with_and_then(add(1)).with_and_then(add(2)).with_and_then(add(3)).with_and_then(lambda df: df.filter("x < 900")).df


@query("SELECT event_id, event_id + CASE WHEN (event_id // 100) % 5 = 0 THEN 1 WHEN (event_id // 100) % 5 = 1 THEN 2 WHEN (event_id // 100) % 5 = 2 THEN 3 ELSE 0 END AS x FROM events")
def q_step_loop(spark, sf_dir):
    """Behaviour that rotates per atom: +1, +2, +3, then twice +0."""
    v = F.col("event_id")
    return Flow(_events(spark, sf_dir)).steps("x", [(v + 1, 1), (v + 2, 1), (v + 3, 1), (v + 0, 2)]).df.select("event_id", "x")


@query(
    """SELECT event_id, coalesce(last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_type END IGNORE NULLS)
         OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'start') AS state FROM events"""
)
def q_vsm(spark, sf_dir):
    """A state machine per user whose state is the last signup or error, in window form."""
    sets = F.when(F.col("event_type").isin("signup", "error"), F.col("event_type"))
    return machines.reset_machine(_events(spark, sf_dir), ["user_id"], sets, "start").select("event_id", "state")


@query(
    """SELECT event_id, (sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) % 2)::BIGINT AS odd FROM events"""
)
def q_vsm_fold(spark, sf_dir):
    """A two-state machine per user that each click flips, as a fold over named behaviours."""

    def even(row, memory):
        return ("odd", [(row["event_id"], 1)]) if row["event_type"] == "click" else ("even", [(row["event_id"], 0)])

    def odd(row, memory):
        return ("even", [(row["event_id"], 0)]) if row["event_type"] == "click" else ("odd", [(row["event_id"], 1)])

    rows = _events(spark, sf_dir).select("event_id", "user_id", "event_type", "__seq")
    return machines.machine(rows, ["user_id"], {"even": even, "odd": odd}, "even", "event_id bigint, odd bigint")


@query(
    """SELECT event_id, greatest(event_id, r) AS released FROM (
         SELECT event_id, min(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id) AS r FROM events) WHERE r IS NOT NULL"""
)
def q_stash(spark, sf_dir):
    """Events wait for the user's first signup."""
    rows = machines.stash_until(_events(spark, sf_dir), ["user_id"], F.col("event_type") == "signup")
    return rows.select("event_id", F.col("__released").alias("released"))


@query("SELECT event_id, -event_id AS reply FROM events")
def q_service_stateless(spark, sf_dir):
    """A service that negates."""
    registry = Registry(spark)
    with App("negate", registry) as app:
        service = app.service("neg")
        service.replier(lambda requests: services.ask_stateless(requests, -F.col("event_id")))
    return registry.get("/negate/services/neg").ask(_table(spark, sf_dir, "events").select("event_id"))


@query("SELECT o_orderkey, c_mktsegment AS segment, c_nationkey AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def q_service_keyed(spark, sf_dir):
    """Orders ask for their customer by key."""
    asked = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    replies = {"segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey")}
    return services.ask_keyed(asked, _table(spark, sf_dir, "customer"), ["c_custkey"], replies).drop("c_custkey")


@query(
    """WITH u AS (SELECT event_id // 100 AS a, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS s FROM events WHERE event_type = 'purchase' GROUP BY 1)
       SELECT event_id, (SELECT sum(s) FROM u WHERE a <= event_id // 100)::BIGINT AS reply FROM events WHERE event_type = 'view'"""
)
def q_service_asof(spark, sf_dir):
    """Views ask for the running total of purchases."""
    events = _events(spark, sf_dir).withColumn("amount", cents(F.col("value")))
    asked = events.filter("event_type = 'view'").select("event_id", "__atom", "__seq")
    return services.ask_as_of(asked, events.filter("event_type = 'purchase'"), "amount").select("event_id", "reply")


@query(
    """SELECT event_id, reply FROM (SELECT event_id, event_type, sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) END)
         OVER (PARTITION BY user_id ORDER BY event_id // 100, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, event_id)::BIGINT AS reply FROM events
         WHERE event_type IN ('purchase', 'view')) WHERE event_type = 'view'"""
)
def q_service_asof_keyed(spark, sf_dir):
    """Views ask for the user's own running total of purchases."""
    events = _events(spark, sf_dir).withColumn("amount", cents(F.col("value")))
    asked = events.filter("event_type = 'view'").select("event_id", "user_id", "__atom", "__seq")
    return services.ask_as_of(asked, events.filter("event_type = 'purchase'"), "amount", keys=["user_id"]).select("event_id", "reply")


@query("SELECT event_id, coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS reply FROM events")
def q_service_read_write(spark, sf_dir):
    """A cell per user: the reply is what the request before wrote."""
    return services.ask_then_write(_events(spark, sf_dir), "event_id", 0, ["user_id"]).select("event_id", "reply")


@query(
    """SELECT l_orderkey, l_linenumber, CAST(round(p_retailprice * 100) AS BIGINT) + CAST(round(s_acctbal * 100) AS BIGINT) AS total
       FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey"""
)
def q_await_all(spark, sf_dir):
    """Two lookups per request, awaited and summed."""
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
    part = (_table(spark, sf_dir, "part"), ["p_partkey"], {"price": cents(F.col("p_retailprice"))})
    supplier = (_table(spark, sf_dir, "supplier"), ["s_suppkey"], {"balance": cents(F.col("s_acctbal"))})
    return services.await_all(rows, [part, supplier], total=F.col("price") + F.col("balance")).select("l_orderkey", "l_linenumber", "total")


@query("WITH RECURSIVE r AS (SELECT event_id, event_id % 20 AS v FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id, v - 1 FROM r WHERE v >= 1) SELECT * FROM r")
def q_recursive_countdown(spark, sf_dir):
    """Requests that ask for the number below, down to 0."""
    seed = _table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("event_id", (F.col("event_id") % 20).alias("v"))
    return loops.countdown(spark, seed, "v")


@query("WITH RECURSIVE r AS (SELECT 0::BIGINT AS n, 0::BIGINT AS a, 1::BIGINT AS b UNION ALL SELECT n + 1, b, a + b FROM r WHERE n < 60) SELECT n, a AS fib FROM r")
def q_recursive_fib(spark, sf_dir):
    """Fibonacci numbers by requests that ask twice."""
    return loops.fibonacci(spark, 60)


@query("SELECT s_suppkey % 8 - d AS v, s_suppkey FROM supplier, range(1, 9) t(d) WHERE s_suppkey % 8 - d >= 0")
def q_cycle(spark, sf_dir):
    """A workflow that feeds its positive results back to its own input, run until nothing is left."""
    start = _table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 8).alias("v"), "s_suppkey").filter("v > 0")

    def step(rows):
        out = rows.withColumn("v", F.col("v") - 1)
        return out, out.filter("v > 0")

    _checkpoints(spark)
    return loops.until_empty(start, step)


@query("SELECT event_id, r * r * r * r AS x FROM (SELECT event_id, event_id % 1000 AS r FROM events)")
def q_registry_chain(spark, sf_dir):
    """A second application reads the first one's stream by its path; both square."""
    registry = Registry(spark)
    square = lambda flow: flow.with_columns(x=F.col("x") * F.col("x"))
    with App("first", registry) as app:
        source = app.generator(_table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 1000).alias("x")), "numbers")
        app.workflow(source, square, "square")
    with App("second", registry) as app:
        app.workflow(app.refer("/first/workflows/square/stream"), square, "again")
    return registry.stream("/second/workflows/again/stream")


@query(
    """SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_id // 100
         ORDER BY (event_id % 2147483647 * 48271 + 11) % 2147483647, event_id) AS r FROM events) WHERE r <= 10"""
)
def q_reservoir(spark, sf_dir):
    """Ten events of each atom."""
    return keyed.reservoir(_events(spark, sf_dir), 10, "event_id").select("event_id")


@query("SELECT event_id FROM events WHERE ((event_id % 2147483647 * 48271 + 11) % 2147483647) % 10 = 0")
def q_sample(spark, sf_dir):
    """One event in ten, always the same ones."""
    return Flow(_events(spark, sf_dir)).sample(10).df.select("event_id")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 100")
def q_top100(spark, sf_dir):
    """The hundred most ordered parts, exactly."""
    return keyed.top(_table(spark, sf_dir, "lineitem"), ["l_partkey"], 100)


@query(
    """WITH e AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM events)
       SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS checkout, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS items
       FROM e GROUP BY user_id, p HAVING count(CASE WHEN event_type = 'purchase' THEN 1 END) > 0"""
)
def q_cart_checkout(spark, sf_dir):
    """Carts: what was clicked since the user's purchase before, at each purchase."""
    bought = F.col("event_type") == "purchase"
    carts = keyed.since_reset(_events(spark, sf_dir), ["user_id"], bought).groupBy("user_id", "period")
    out = carts.agg(F.max(F.when(bought, F.col("event_id"))).alias("checkout"), F.sum((F.col("event_type") == "click").cast("bigint")).alias("items"))
    return out.filter("checkout IS NOT NULL").drop("period")


@query(
    """WITH RECURSIVE o AS (
         SELECT user_id // 2 AS bank, event_id AS saga, user_id % 2 AS side, CAST(round(value * 100) AS BIGINT) % 50 AS amount, event_type = 'purchase' AS takes,
                row_number() OVER (PARTITION BY user_id // 2 ORDER BY event_id) AS nr FROM events),
       r AS (
         SELECT DISTINCT bank, 0::BIGINT AS nr, 0::BIGINT AS b0, 0::BIGINT AS b1, NULL::BIGINT AS saga, true AS success FROM o
         UNION ALL
         SELECT bank, nr, CASE WHEN NOT ok THEN b0 WHEN side = 0 OR NOT takes THEN b0 + amount ELSE b0 - amount END,
                CASE WHEN NOT ok THEN b1 WHEN side = 1 OR NOT takes THEN b1 + amount ELSE b1 - amount END, saga, ok
         FROM (SELECT o.*, r.b0, r.b1, NOT (o.takes AND CASE WHEN o.side = 0 THEN r.b1 ELSE r.b0 END < o.amount) AS ok
               FROM r JOIN o ON o.bank = r.bank AND o.nr = r.nr + 1))
       SELECT saga, success FROM r WHERE saga IS NOT NULL"""
)
def q_bank_saga(spark, sf_dir):
    """All-or-nothing transactions between the two accounts of each pair of users, in stream order."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    bank = F.floor(F.col("user_id") / 2).cast("bigint").alias("bank")
    second = F.when(F.col("event_type") == "purchase", "withdraw").otherwise("deposit")
    ops = F.explode(F.array(
        F.struct(F.lit(0).alias("i"), F.lit("deposit").alias("kind"), F.col("user_id").alias("account")),
        F.struct(F.lit(1).alias("i"), second.alias("kind"), (F.col("user_id") + 1 - 2 * (F.col("user_id") % 2)).alias("account")),
    ))
    rows = events.select(bank, F.col("event_id").alias("saga"), (cents(F.col("value")) % 50).alias("amount"), ops.alias("o"))
    return machines.sagas(rows.select("bank", "saga", (F.col("saga") * 2 + F.col("o.i")).alias("__seq"), "o.kind", "o.account", "amount"), ["bank"])


_TREE = """WITH RECURSIVE r AS (
  SELECT event_id, (event_id % {mod})::BIGINT AS n FROM events WHERE event_type = '{kind}'
  UNION ALL SELECT event_id, n - d FROM r, (VALUES (1), (2)) t(d) WHERE n >= 2)
SELECT event_id, sum(CASE WHEN n < 2 THEN n ELSE 0 END)::BIGINT AS fib, count(*) AS calls FROM r GROUP BY 1"""


@query(_TREE.format(mod=8, kind="signup"))
def q_recursive_tree(spark, sf_dir):
    """Fibonacci numbers by requests that ask two others and await both, as a tree of requests for every signup."""
    n = F.col("n")
    start = _table(spark, sf_dir, "events").filter("event_type = 'signup'").select("event_id", (F.col("event_id") % 8).cast("bigint").alias("n"))
    _checkpoints(spark)
    asks = F.array(F.struct((n - 1).alias("n")), F.struct((n - 2).alias("n")))
    return loops.ask_tree(start, ["event_id"], n < 2, n, asks, lambda r: F.sum(r)).withColumnRenamed("reply", "fib")


@query("SELECT event_id, fib FROM (" + _TREE.format(mod=6, kind="error") + ")")
def q_actor_fib(spark, sf_dir):
    """Fibonacci numbers by actors: for every error a tree with an actor for each call, which asks two more and adds up their replies."""

    def call(c: Context, m: dict) -> str | None:
        if "n" in m and m["n"] >= 2:
            c.value("asker").set(m["asker"])
            for less in (1, 2):
                c.send(c.create("call"), {"n": m["n"] - less, "asker": c.self_id})
            return None
        if "n" in m:
            c.send(m["asker"], {"fib": m["n"]})
            return "stopped"
        total, waiting = c.value("total", 0), c.value("waiting", 2)
        total.set(total.get() + m["fib"])
        waiting.set(waiting.get() - 1)
        if waiting.get():
            return None
        c.send(c.value("asker").get(), {"fib": total.get()})
        return "stopped"

    def root(c: Context, m: dict) -> str | None:
        if "n" in m:
            c.send(c.create("call"), {"n": m["n"], "asker": c.self_id})
            return None
        c.emit({"fib": m["fib"]})
        return "stopped"

    _checkpoints(spark)
    seeds = _table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("event_id").alias("target"), (F.col("event_id") % 6).alias("n"))
    actors = seeds.select("target", F.lit("root").alias("behaviour"), F.lit("{}").alias("memory"))
    messages = seeds.select("target", F.lit(0).cast("bigint").alias("seq"), F.to_json(F.struct("n")).alias("body"))
    out = run_actors(spark, {"call": call, "root": root}, actors, messages)
    return out.select(F.col("target").alias("event_id"), field_of("body", "fib").alias("fib"))


@query("SELECT item_id, (CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)::INTEGER AS hash FROM (SELECT item_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM benchmark)")
def q_java_hash(spark, sf_dir):
    """The JVM's hash of a text's letters, as a key."""
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return _table(spark, sf_dir, "benchmark").select("item_id", java_hash(letters).alias("hash"))


_PRICE = "CAST(round(value * 100) AS BIGINT)"


@query(
    f"""SELECT event_id, count(*) OVER w AS n, min({_PRICE}) OVER w AS least, max({_PRICE}) OVER w AS most,
          last_value(CASE WHEN value < 50 THEN event_id END IGNORE NULLS) OVER w AS small, coalesce(lag(user_id) OVER (PARTITION BY event_type ORDER BY event_id), -1) AS previous,
          coalesce(last_value(CASE WHEN user_id % 3 = 0 THEN user_id END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS state
        FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def q_running_split(spark, sf_dir):
    """Count, least, most, last value, previous value and machine state over five keys that hold all rows, in blocks of the stream."""
    price = cents(F.col("value"))
    rows = _events(spark, sf_dir).select("event_id", "event_type", "user_id", "value", "__seq")
    values = {
        "n": ("sum", F.lit(1).cast("bigint")), "least": ("min", price), "most": ("max", price), "small": ("last", F.when(F.col("value") < 50, F.col("event_id"))),
    }
    rows = keyed.running(rows, values, ["event_type"], block=F.floor(F.col("__seq") / 1000))
    rows = keyed.previous(rows, ["event_type"], "user_id", -1, split=True)
    rows = machines.reset_machine(rows, ["event_type"], F.when(F.col("user_id") % 3 == 0, F.col("user_id")), -1, split=True)
    return rows.select("event_id", "n", "least", "most", "small", "previous", "state")


@query(
    f"""SELECT event_id, sum(CASE WHEN event_id % 100 >= 5 THEN {_PRICE} END) OVER (PARTITION BY nullif(event_type, 'view') ORDER BY event_id)::BIGINT AS total FROM events"""
)
def q_running_sum_null_keys(spark, sf_dir):
    """Running sums of hot keys, one of which is null, where every atom begins with null values."""
    rows = _events(spark, sf_dir).withColumn("k", F.nullif("event_type", F.lit("view")))
    return keyed.running_sum_salted(rows, ["k"], F.when(F.col("event_id") % 100 >= 5, cents(F.col("value")))).select("event_id", "total")


@query("SELECT event_id, user_id % 10 AS k, count(*) OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS n FROM events")
def q_key_default(spark, sf_dir):
    """A contextual key, by which the keyed operators behind it partition, dealt by ranges first."""
    rows = Flow(_events(spark, sf_dir)).key(F.col("user_id") % 10).ranges(4).processor(lambda df: keyed.running_count(df, None))
    return rows.df.select("event_id", F.col("__key").alias("k"), "n")


@query(
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2 * (event_id % 100) + 1 ELSE 2 * (event_id % 100 + 10) + 1 END AS x FROM events
       UNION ALL SELECT event_id, event_id % 100 + 7 FROM events"""
)
def q_union_hooks(spark, sf_dir):
    """Hooks behind a union, on a source and on every operator: no flow's rows get lost."""
    rows = Flow(_events(spark, sf_dir).select("event_id", (F.col("event_id") % 100).alias("x")))
    even, odd = rows.split(F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1)
    both = even.union(odd.with_columns(x=F.col("x") + 10)).with_on_next(lambda df: df.withColumn("x", 2 * F.col("x")))
    both = both.with_wrapper(lambda df, run: run(df).withColumn("x", F.col("x") + 1))
    source = rows.with_on_next(lambda df: df.withColumn("x", F.col("x") + 7))
    return both.union(source).all_with_wrapper(lambda df, run: run(df)).df


@query(
    """SELECT event_id, dense_rank() OVER (ORDER BY event_id // 100, i) - 1 AS atom, row_number() OVER (ORDER BY event_id // 100, i, event_id) - 1 AS seq,
         row_number() OVER (ORDER BY i, event_id) - 1 AS behind
       FROM (SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS i FROM events WHERE event_type IN ('view', 'click', 'purchase'))"""
)
def q_sequencer_order(spark, sf_dir):
    """The atoms and numbers of merged streams, atom by atom and input after input."""
    events = _events(spark, sf_dir).select("event_id", "__atom", "__seq")
    events = events.join(_table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id").repartition(5)
    parts = events.filter(F.col("event_type").isin("view", "click")), events.filter("event_type = 'purchase'")
    one = Sequencer(*parts).numbered().select("event_id", F.col("__atom").alias("atom"), F.col("__seq").alias("seq"))
    other = Sequencer(*parts, policy=Sequencer.ONE_AFTER_ANOTHER).numbered()
    return one.join(other.select("event_id", F.col("__seq").alias("behind")), "event_id")


@query(
    f"""SELECT a AS atom, max(m) OVER (ORDER BY a) AS top, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (ORDER BY a)::BIGINT AS total
        FROM (SELECT DISTINCT event_id // 100 AS a FROM events) LEFT JOIN
             (SELECT event_id // 100 AS a, max({_PRICE}) AS m, count(*) AS n FROM events WHERE user_id = 7 GROUP BY 1) USING (a)"""
)
def q_atom_ends(spark, sf_dir):
    """Ends of all atoms of one user's events, those without rows too: their number, and maximum and number up to there."""
    events = _events(spark, sf_dir)
    own = Flow(events.filter("user_id = 7").select("__atom", "__seq", cents(F.col("value")).alias("price")))
    out = own.with_on_atom_complete(cumulative={"top": "max", "total": "sum"}, atoms=events, top=F.max("price"), n=F.count("*"), total=F.count("*"))
    return out.df.filter("__end").select(F.col("__atom").alias("atom"), "top", "n", "total")


@query(
    """SELECT event_id, released, size FROM (
         SELECT event_id, event_type, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS released,
                row_number() OVER (PARTITION BY user_id, p ORDER BY event_id) AS size
         FROM (SELECT *, count(CASE WHEN event_type = 'purchase' THEN 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
               FROM events WHERE event_type IN ('click', 'purchase'))) WHERE event_type = 'click' AND released IS NOT NULL"""
)
def q_stash_general(spark, sf_dir):
    """Clicks are stashed until the user's next purchase, which unstashes them all; each with its place in the stash."""

    def open_(row: dict, memory: dict, stash: machines.Stash) -> tuple[str, list[tuple]]:
        if row["event_type"] == "purchase":
            memory["at"] = row["event_id"]
            out = stash.unstash_all()
            memory["at"] = None
            return "open", out
        if memory.get("at") is None:
            stash.stash({**row, "place": stash.size() + 1})
            return "open", []
        return "open", [(row["event_id"], memory["at"], row["place"])]

    rows = _events(spark, sf_dir).filter("event_type IN ('click', 'purchase')").select("event_id", "user_id", "event_type", "__seq")
    return machines.machine(rows, ["user_id"], {"open": open_}, "open", "event_id bigint, released bigint, size bigint", stash=True)


@query(
    """SELECT event_id, total, asked FROM (
         SELECT event_id, event_type, coalesce(sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) END) OVER w, 0)::BIGINT AS total,
                sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER w::BIGINT AS asked
         FROM events WHERE event_type IN ('purchase', 'view')
         WINDOW w AS (PARTITION BY user_id ORDER BY event_id // 100, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, event_id)) WHERE event_type = 'view'"""
)
def q_service_shared_state(spark, sf_dir):
    """A replier whose purchases and requests share a user's memory: the total, and how often it was asked for."""
    events = _events(spark, sf_dir).select("event_id", "user_id", "event_type", cents(F.col("value")).alias("price"), "__atom", "__seq")

    def on_event(row: dict, memory: dict) -> None:
        memory["total"] = memory.get("total", 0) + row["price"]

    def on_request(row: dict, memory: dict) -> list[tuple]:
        memory["asked"] = memory.get("asked", 0) + 1
        return [(row["event_id"], memory.get("total", 0), memory["asked"])]

    registry = Registry(spark)
    with App("purse", registry) as app:
        service = app.service("total")
        service.replier_of(events.filter("event_type = 'purchase'"), ["user_id"], on_event, on_request, "event_id bigint, total bigint, asked bigint")
    return registry.get("/purse/services/total").ask(events.filter("event_type = 'view'"))


def _checkpoints(spark: SparkSession) -> None:
    """A folder for checkpoints of a local session that names none; a cluster must name one that its executors share."""
    if not spark.conf.get("spark.checkpoint.dir", ""):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="atomflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
