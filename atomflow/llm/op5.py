"""Query of operator 5: all documents packed into rows of 1024 tokens."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from atomflow.llm.packing import assigned
from atomflow.llm.pieces import token_pieces
from atomflow.llm.scratch import stored

CAPACITY = 1024
END_ID = 2


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece of docs (doc_id, text) with its row and place.

    Rows that repeat a doc_id are separate documents; a null id is kept; a null text is an empty one, the end id alone. Texts of any length are taken whole and
    cut into pieces. Which of several pieces of one length goes where is settled by a hash of (doc_id, piece). Only the columns for id and text are read, so
    others may have any names; an empty table gives no rows.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    pieces = stored(token_pieces(docs, path, capacity, end_id), "pieces")
    out = assigned(pieces, capacity, ["doc_id", "piece"])
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
