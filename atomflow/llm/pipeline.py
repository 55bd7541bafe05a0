"""Corpus preparation in five stages, each over all that the stage before it kept.

toxicity: documents whose predicted grade is above 0 go. exact dedup: of texts that are equal but for white space,
one stays. near dedup: of documents linked on runs of five words at a similarity of 0.8 or more, the one with the smallest id
stays (ids may repeat or be null: documents are told by id and text). repeats: words in passages of 50 words or more that an earlier document has go; the
document stays, with its text as it was if nothing is removed. packing: token pieces of the rest in rows of 1024.

All stages but the last return the columns of documents, whatever else and under whatever names they hold, in their order. A document that
loses words gets its new length in n_chars, if there is such a column.

Defined results of every stage: an empty table gives an empty one. A null text is an empty one: it isn't toxic, equals all other texts
without words, is near to nothing, repeats nothing, and is packed as the end id alone. Rows without an id are documents of their own;
rows that repeat an id are told apart by their texts, and rows that repeat id and text are one document from the exact stage on. Of ties
(equal lengths) the smallest id stays. Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atomflow.llm.exact_dedup import kept_rows
from atomflow.llm.op5 import pack_documents
from atomflow.llm.scratch import stored
from atomflow.llm.setsketch import without_near_copies
from atomflow.llm.substring import without_repeats
from atomflow.llm.toxicity import learn_from, without_toxic

#: Words of a repeated passage.
PASSAGE = 50


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without_toxic(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_copies(docs, k=5, num=80, den=100)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs, PASSAGE)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("substring dedup", repeats), ("best-fit packing", packing)]

#: A trained model and a packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
