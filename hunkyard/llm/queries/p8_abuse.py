"""Queries of problem 8: abusive, hateful or sexual texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkyard.llm.abuse import THRESHOLD, score, train
from hunkyard.sources.tables import table


def _scored(spark: SparkSession, d: str, others: tuple[str, ...] = ()) -> DataFrame:
    docs = table(spark, d, "documents")
    return score(docs, train(docs, table(spark, d, "labels")), others)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose expected severity reaches the threshold."""
    return _scored(spark, d).where(F.col("severity") >= THRESHOLD).select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """The expected severity of every document."""
    return _scored(spark, d)


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, mean severity and share of abusive ones per source."""
    g = _scored(spark, d, ("source",)).groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("severity") >= THRESHOLD).alias("abusive"), F.round(F.avg("severity"), 6).alias("mean_severity"))
    return g.withColumn("rate", F.round(F.col("abusive") / F.col("documents"), 6))


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
ORACLES: dict[str, str] = {}
