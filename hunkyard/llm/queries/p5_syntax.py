"""Queries of problem 5: source texts and snippets that do not parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkyard.llm.syntax import flag
from hunkyard.sources.tables import table


def _all(spark: SparkSession, d: str, only_bad: bool) -> DataFrame:
    files = flag(table(spark, d, "source_files"), "src_id", "content", "path", "language", "content", "repo", only_bad)
    return files.unionByName(flag(table(spark, d, "patches"), "patch_id", "patched_snippet", "file_path", None, "patched_snippet", "repo", only_bad))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose text does not parse."""
    return _all(spark, d, True).select("field", "row_id")


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose text does not parse, with language and reason."""
    return _all(spark, d, True).select("field", "row_id", "language", "reason")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """Texts, invalid texts and their rate per repository and language."""
    g = _all(spark, d, False).groupBy(F.col("grp").alias("repo"), "language").agg(F.count("*").alias("texts"), F.count("reason").alias("invalid"))
    return g.withColumn("rate", F.round(F.col("invalid") / F.col("texts"), 6))


def p5_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Per language, texts found by lexer and stacks, texts found by the exact check alone, and objections it overruled."""
    return _all(spark, d, False).where("found_by is not null").groupBy("language", "found_by").agg(F.count("*").alias("texts"))


QUERIES = {"p5_found": p5_found, "p5_reasons": p5_reasons, "p5_rates": p5_rates, "p5_agreement": p5_agreement}
ORACLES: dict[str, str] = {}
