"""Query of operator 2: BPE ids of whole documents, and back."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from atomflow.llm.bpe_chunks import encode_documents


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), full=False)
