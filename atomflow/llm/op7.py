"""Query of operator 7: words of passages that an earlier document has."""

from pyspark.sql import DataFrame, SparkSession

from atomflow.llm.substring import remove_repeats


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), 13, full=False)


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS pos FROM w WHERE len(w) >= 13),
s AS (SELECT doc_id, pos, array_to_string(w[pos : pos + 12], ' ') AS x FROM k),
m AS (SELECT x, min(doc_id) AS least FROM s GROUP BY x HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT s.doc_id, pos + d AS pos FROM s JOIN m ON s.x = m.x AND least < s.doc_id CROSS JOIN range(0, 13) t(d)),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
o AS (SELECT p.doc_id, count(*) FILTER (WHERE g.pos IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY p.pos) FILTER (WHERE g.pos IS NULL) AS kept
      FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.pos = p.pos GROUP BY p.doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN o ON o.doc_id = w.doc_id
"""
