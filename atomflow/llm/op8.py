"""Query of operator 8: documents as packed id matrices, written and read back."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from atomflow.llm.matrices import packed_matrices, read_matrices, write_matrices
from atomflow.llm.scratch import fresh_path


def op8_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "matrices")
    write_matrices(packed_matrices(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")), path)
    return read_matrices(spark, path)
