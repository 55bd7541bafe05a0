"""Query of operator 3: near-duplicate documents on runs of three words at 0.85."""

from pyspark.sql import DataFrame, SparkSession

from atomflow.llm.setsketch import near_duplicates


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=85, den=100)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
t AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM t),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i WHERE 100 * shared >= 85 * (na + nb - shared)),
f AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, f.b FROM r JOIN f ON f.a = r.reached),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT t.doc_id, len(s) AS n_shingles, component_id, t.doc_id = component_id AS kept FROM t JOIN c ON node = t.doc_id
"""
