"""Savings report: exact duplicates merged, bytes before and after by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def merge_identical(files: DataFrame, content: str = "text", key: str = "doc_id") -> DataFrame:
    """A1: files with ``keeper``, the smallest key among files of equal content; files without a content are
    their own keepers.

    Only a digest and the key are shuffled; contents stay where they are."""
    digest = F.sha2(F.col(content).cast("binary"), 256)
    keepers = files.where(F.col(content).isNotNull()).groupBy(digest.alias("_d")).agg(F.min(key).alias("_k"))
    return files.withColumn("_d", digest).join(keepers, "_d", "left").withColumn("keeper", F.coalesce("_k", key)).drop("_d", "_k")


def savings_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    merged = merge_identical(files)
    keeps = F.col("doc_id") == F.col("keeper")
    out = merged.groupBy("source").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("original_size"), F.sum(F.when(keeps, F.col("size")).otherwise(0)).cast("long").alias("candidate_size"), F.count_if(~keeps).alias("duplicates")
    )
    smaller = F.col("candidate_size") < F.col("original_size")  # P24: never larger, and counters are reset when the original is kept
    return out.select(
        "source",
        "files",
        "original_size",
        F.when(smaller, F.col("candidate_size")).otherwise(F.col("original_size")).alias("output_size"),
        F.when(smaller, F.col("duplicates")).otherwise(0).cast("long").alias("duplicates_merged"),
        (~smaller).alias("kept_original"),
    )


SAVINGS_SQL = """
WITH f AS (SELECT doc_id, text, source, coalesce(octet_length(encode(text)), 0) AS size FROM documents),
m AS (SELECT *, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS keeper FROM f),
g AS (SELECT source, count(*) AS files, CAST(sum(size) AS BIGINT) AS original_size,
      CAST(sum(CASE WHEN doc_id = keeper THEN size ELSE 0 END) AS BIGINT) AS candidate_size,
      count(*) FILTER (WHERE doc_id <> keeper) AS duplicates FROM m GROUP BY source)
SELECT source, files, original_size,
  CASE WHEN candidate_size < original_size THEN candidate_size ELSE original_size END AS output_size,
  CAST(CASE WHEN candidate_size < original_size THEN duplicates ELSE 0 END AS BIGINT) AS duplicates_merged,
  NOT (candidate_size < original_size) AS kept_original
FROM g
"""

QUERIES = {"savings_report": savings_report}
ORACLE_SQL = {"savings_report": SAVINGS_SQL}
