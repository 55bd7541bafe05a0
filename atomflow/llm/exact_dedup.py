"""Exact duplicates by a persistent digest index, bucketed and sorted by digest.

Two texts are equal when they are identical after every character of ``[\\x20\\x09-\\x0D]`` has
been deleted; a null text is an empty one. The index holds one row per distinct digest that
was ever kept. A batch of new documents is reduced to one row per digest before anything is
shuffled by it (so a digest that a third of the rows share costs one row per task), the
digests that the index lacks are found by a sort-merge anti-join of bucketed, sorted data
and appended. Only DataFrame operations run; there is no Python on the executors.

A batch has a name, by default one made of its rows (their number, ids, digests and lengths). Rows that the index has of the batch's own name count
as the batch's own: a batch that is run again, since the job failed after it had been appended, is judged as before, and is
appended once. Batches must be judged one after the other.

``exact_dedup`` judges one table: half of it is appended first; the anti-join tells which digests of the other half are new,
and for those that aren't, the better row of both halves stays.

Defined results: of equal texts in a batch, the row with the most code points in its
original text stays, then the smallest id (null ids last). What an earlier batch kept stays kept,
whatever comes later. Repeated rows with the same id and text are separate members of their
group; of them, all carry kept = true if their id is the kept one. Very long texts are hashed whole, row by row. An empty batch gives no
rows and leaves the index as it was. Further columns of the input are ignored, whatever
their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atomflow.llm.scratch import fresh_path, rows_that_stay, shuffle_partitions, stored

WHITE_SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without white space; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return stored(
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), digest_of(text).alias("digest"), F.coalesce(F.char_length(text), F.lit(0)).cast("bigint").alias("length")),
        "batch-digests",
    )


def _groups(digests: DataFrame) -> DataFrame:
    """One row for each digest: the row that stays as best, the larger the better, and how many rows there are."""
    best = F.struct("length", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("back"))
    return digests.groupBy("digest").agg(F.max(best).alias("best"), F.count("*").alias("size"))


class DigestIndex:
    """A bucketed table of the digests that were kept, with what stands for each and the batch that brought it."""

    SCHEMA = "digest binary, best struct<length: bigint, known: boolean, back: bigint>, size bigint, batch string"

    def __init__(self, spark: SparkSession, table: str | None = None, path: str | None = None, buckets: int | None = None):
        """Opens the table, or makes it. Without a path it lies in the shared folder and ends with the driver."""
        self.spark = spark
        self.table = table or f"digests_{uuid.uuid4().hex}"
        self.buckets = buckets or shuffle_partitions(spark)
        if not spark.catalog.tableExists(self.table):
            self.path = path or fresh_path(spark, "digests")
            spark.sql(
                f"CREATE TABLE {self.table} ({self.SCHEMA}) USING parquet"
                f" CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def close(self) -> None:
        """Forgets the table; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def new(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index lacks: a sort-merge anti-join, for which only the groups are shuffled."""
        return groups.join(self.rows().hint("merge").select("digest"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Adds those of the groups that the index lacks; each bucket gets one sorted file."""
        (
            self.new(groups).select("digest", "best", "size", F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest").sortWithinPartitions("digest")
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)
        )

    def deduplicate(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Judges a batch and appends what is new in it.

        Returns per row of the batch: doc_id, keep_id (the row that stays for its text, of
        this or of an earlier batch), group_size (equal texts in this batch), kept and digest.
        """
        digests = _digests(docs, id_col, text_col)
        if batch is None:
            own = F.xxhash64("doc_id", "digest", "length")
            r = digests.agg(F.count("*").alias("n"), F.bit_xor(own).alias("x"), F.sum(F.shiftrightunsigned(own, 40)).alias("s")).first()
            batch = f"{r['n']}-{r['x']}-{r['s']}"
        groups = stored(_groups(digests), "batch-groups")
        self.append(groups, batch)
        earlier = self.rows().filter(F.col("batch") != batch).select("digest", F.col("best").alias("old"))
        judged = groups.join(earlier.hint("merge"), "digest", "left").select("digest", F.coalesce("old", "best").alias("best"), "size", F.col("old").isNotNull().alias("earlier"))
        return _judged_rows(digests, judged)


def _judged_rows(digests: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of a batch with the verdict on their digests (digest, best, size, earlier)."""
    # Stored, so that this join shuffles both sides and a digest of very many rows is split among tasks.
    judged = stored(judged.select("digest", (-F.col("best.back")).alias("keep_id"), F.col("size").alias("group_size"), "earlier"), "judged")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("earlier")
    return digests.join(judged.hint("merge"), "digest").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest", "length")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One table against an index of its own: doc_id, keep_id, group_size, kept, digest."""
    index = DigestIndex(docs.sparkSession)
    digests = _digests(docs, id_col, text_col)
    second = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    # Stored, as Spark would otherwise take the anti-join below the aggregate and shuffle every row of a digest.
    index.append(stored(_groups(digests.filter(~second)), "batch-groups"), "first")
    groups = stored(_groups(digests.filter(second)), "batch-groups")
    index.append(groups, "second")
    # A digest of both halves is in the index with its first half: the better row of the two stays, and their sizes add up.
    other = groups.select("digest", F.col("best").alias("own"), F.col("size").alias("more"))
    both = index.rows().filter("batch = 'first'").join(other.hint("merge"), "digest", "left")
    merged = both.select("digest", F.greatest("best", "own").alias("best"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
    judged = merged.unionByName(index.rows().filter("batch = 'second'").select("digest", "best", "size"))
    out = _judged_rows(digests, judged.withColumn("earlier", F.lit(False))).drop("length")
    index.close()
    return out


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their own columns: one for each distinct text.

    Rows of one id and equal texts are rare and settled apart: the longest stays, then the first in the order of texts.
    Null ids and texts, empty tables and further columns of any name are as in exact_dedup.
    """
    names = [f"_{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    doc_id, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    judged = stored(exact_dedup(docs, id_col, text_col).select("doc_id", "digest", "kept"), "judged-rows")
    digest = digest_of(F.col(text).cast("string"))
    stay = rows_that_stay(own, judged, doc_id, digest)
    twice = stored(judged.filter("kept").groupBy(F.col("doc_id").alias("_twice_id"), "digest").agg(F.count("*").alias("_rows")).filter("_rows > 1"), "repeated")
    if not twice.take(1):
        return stay.toDF(*docs.columns)
    ids = twice.select("_twice_id").distinct().hint("merge")
    same = F.col(doc_id).cast("bigint").eqNullSafe(F.col("_twice_id"))
    first = W.partitionBy(doc_id, digest).orderBy(F.char_length(F.col(text).cast("string")).desc_nulls_last(), text)
    once = stay.join(ids, same, "left_semi").withColumn("_nr", F.row_number().over(first)).filter("_nr = 1").drop("_nr")
    return stay.join(ids, same, "left_anti").unionByName(once).toDF(*docs.columns)
