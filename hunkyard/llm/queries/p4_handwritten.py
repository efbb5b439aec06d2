"""Queries of problem 4: changed files that no person of the repository wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkyard.llm.handwritten import classify
from hunkyard.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose file was generated, minified, vendored or is data."""
    return classify(table(spark, d, "diff_files")).where("kind is not null").select("diff_id")


def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The same rows with what made the file."""
    return classify(table(spark, d, "diff_files")).where("kind is not null").select("diff_id", "kind")


def p4_routes(spark: SparkSession, d: str) -> DataFrame:
    """How many verdicts of each kind rest on which evidence: layout, shared pieces, banners, names, other rows of the file."""
    return classify(table(spark, d, "diff_files")).groupBy(F.coalesce("kind", F.lit("hand-written")).alias("kind"), "route").agg(F.count("*").alias("rows"))


def p4_against_skipped(spark: SparkSession, d: str) -> DataFrame:
    """How often the recorded reason for skipping and the verdict agree, per kind."""
    t = table(spark, d, "diff_files").select("diff_id", F.coalesce(F.col("skipped_reason").startswith("ignored"), F.lit(False)).alias("ignored"))
    return classify(table(spark, d, "diff_files")).join(t, "diff_id").groupBy(F.coalesce("kind", F.lit("hand-written")).alias("kind"), "ignored").agg(F.count("*").alias("rows"))


QUERIES = {"p4_found": p4_found, "p4_kinds": p4_kinds, "p4_routes": p4_routes, "p4_against_skipped": p4_against_skipped}
ORACLES: dict[str, str] = {}
