"""Intermediate tables in the folder that driver and executors share, and joins whose small side may be broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, SparkSession] = {}
#: Rows of a few numbers that are broadcast at most (some 20 bytes each); beyond, the same join shuffles.
BROADCAST_ROWS = 1_000_000
#: Rows of a join key from which it is split among tasks.
HOT = 256


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder of a local session, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="atomflow-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/atomflow-{label}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows of df, written as Parquet to the shared folder and read again.

    This cuts the lineage: a lost executor costs no more than a reread of the files. The
    files stay until release() or the end of the driver, since the result is lazy.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _made.pop(path, None)


def release() -> None:
    """Deletes every intermediate table of this driver; results that read them end with it."""
    for path, spark in list(_made.items()):
        try:
            remove(spark, path)
        except Exception:  # the session may be gone, and its folder with it
            _made.pop(path, None)


atexit.register(release)


def small_side(df: DataFrame) -> DataFrame:
    """df (a stored table of few columns) to be joined: broadcast if it has few enough rows, else by a shuffle of both sides."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def split_join(many: DataFrame, one: DataFrame, on: str, spread: str, sizes: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """many (a stored table) joined with one, which has a row for each value of on, without any value in one task.

    Values with HOT rows or more are dealt over several tasks by a hash of spread, and their row of one goes to each of them. sizes: on and
    the number of rows as n, where they are known.
    """
    sizes = many.groupBy(on).agg(F.count("*").alias("n")) if sizes is None else sizes
    hot = sizes.filter(F.col("n") >= HOT).select(on, F.ceil(F.col("n") / HOT).cast("int").alias("_salts"))
    if not hot.take(1):
        return many.join(one.hint("merge"), on, how)
    hot = stored(hot, "hot")
    salts = F.coalesce("_salts", F.lit(1))
    dealt = many.join(small_side(hot), on, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts)).drop("_salts")
    copied = one.join(small_side(hot), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(copied.hint("merge"), [on, "_salt"], how).drop("_salt")


def rows_that_stay(docs: DataFrame, judged: DataFrame, id_col: str, digest: Column) -> DataFrame:
    """The rows of docs, with all their columns, that were judged to stay.

    judged (a stored table): doc_id, digest and kept of every row. Most rows stay and most ids have one row, so what is looked up is the ids
    whose rows all go; texts are neither hashed again nor, while those ids can be broadcast, shuffled. Where an id has rows of which some stay,
    its rows are told apart by digest, an expression over docs.
    """
    flags = judged.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("long")).alias("stay"))
    gone = stored(flags.filter("stay < n").select(F.col("doc_id").alias("_gone_id"), (F.col("stay") > 0).alias("_some")), "gone")
    own = F.col(id_col).cast("bigint")
    rest = docs.join(small_side(gone.select("_gone_id")), own.eqNullSafe(F.col("_gone_id")), "left_anti")
    odd = gone.filter("_some").select("_gone_id")
    if not odd.take(1):
        return rest
    odd_rows = docs.join(small_side(odd), own.eqNullSafe(F.col("_gone_id")), "left_semi")
    stay = judged.filter("kept").join(small_side(odd), F.col("doc_id").eqNullSafe(F.col("_gone_id")), "left_semi")
    stay = stay.select(F.col("doc_id").alias("_kept_id"), F.col("digest").alias("_kept_digest")).distinct()
    return rest.unionByName(odd_rows.join(stay.hint("merge"), own.eqNullSafe(F.col("_kept_id")) & (digest == F.col("_kept_digest")), "left_semi"))


def input_bytes(df: DataFrame, text_col: str) -> int:
    """Size of df, for choosing partition counts: Catalyst's estimate, which reads nothing; where it has none (or multiplies
    the sides of joins), half the bytes of the texts, which are then counted."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known <= 10**15:
        return known
    return (df.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("n")).first()["n"] or 0) // 2


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
