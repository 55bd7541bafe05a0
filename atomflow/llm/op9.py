"""Query of operator 9: pages to WARC archives and back."""

from pyspark.sql import DataFrame, SparkSession

from atomflow.llm.scratch import fresh_path
from atomflow.llm.warc import read_archives, row_id, write_archives


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    out = read_archives(spark, path, payloads=False)
    return out.select(
        row_id(out["record_id"]).alias("page_id"), "payload_bytes", "payload_digest", out["type"].alias("record_type"),
        row_id(out["refers_to"]).alias("refers_to"),
    )


SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""
