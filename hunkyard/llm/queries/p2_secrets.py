"""Queries of problem 2: credentials in diffs and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkyard.llm.secrets import scan
from hunkyard.sources.tables import table


def _all(spark: SparkSession, d: str, masked: bool) -> DataFrame:
    diffs = scan(table(spark, d, "diff_files"), "diff_id", "file_path", ["patch", "full_content"], masked)
    return diffs.unionByName(scan(table(spark, d, "source_files"), "src_id", "path", ["content"], masked))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every line with a credential, of all three text columns."""
    return _all(spark, d, False)


def p2_masked(spark: SparkSession, d: str) -> DataFrame:
    """The texts that held credentials, with these masked and all else unchanged."""
    return _all(spark, d, True)


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """Lines with credentials and rows with any, per repository and field."""
    ids = table(spark, d, "diff_files").select(F.col("diff_id").alias("row_id"), "repo", F.lit(False).alias("snapshot")).unionByName(table(spark, d, "source_files").select(F.col("src_id").alias("row_id"), "repo", F.lit(True).alias("snapshot")))
    hits = _all(spark, d, False).groupBy("field", "row_id").agg(F.count("*").alias("lines")).withColumn("snapshot", F.col("field") == "content")
    return hits.join(ids, ["snapshot", "row_id"]).groupBy("repo", "field").agg(F.sum("lines").alias("lines"), F.count("*").alias("rows"))


QUERIES = {"p2_found": p2_found, "p2_masked": p2_masked, "p2_rates": p2_rates}
ORACLES: dict[str, str] = {}
