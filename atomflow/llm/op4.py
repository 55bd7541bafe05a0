"""Query of operator 4: expected severity of toxic language in every document."""

from pyspark.sql import DataFrame, SparkSession

from atomflow.llm.toxicity import learn_from, severity


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return severity(docs, learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
