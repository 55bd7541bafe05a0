"""Query of operator 1: maximal conversations, rendered."""

from pyspark.sql import DataFrame, SparkSession

from atomflow.llm.chat import collapse_and_render


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (
  SELECT conv_id, count(*) AS n_turns,
         list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
                    ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text
  FROM t GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, n_turns, turns, min(text) AS text, count(*) AS n_copies FROM c GROUP BY n_turns, turns),
p AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM c))
SELECT conv_id, n_turns, n_copies, text FROM u WHERE turns NOT IN (SELECT turns FROM p)
"""
