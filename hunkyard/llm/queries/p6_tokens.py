"""Queries of problem 6: the corpus as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkyard.llm.bpe import encode, round_trip
from hunkyard.sources.tables import table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every text."""
    return encode(table(spark, d, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Whether the ids of every text decode to it."""
    return round_trip(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("row_id", "doc_id")


def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    """Texts, tokens and characters a token of each source and language."""
    n = encode(table(spark, d, "documents").withColumn("chars", F.coalesce(F.length("text"), F.lit(0))), "doc_id", "text", others=("source", "lang", "chars"), counts=True)
    g = n.groupBy("source", "lang").agg(F.count("*").alias("texts"), F.sum("n_tokens").alias("tokens"), F.sum("chars").alias("chars"))
    return g.withColumn("chars_per_token", F.round(F.try_divide("chars", "tokens"), 4)).drop("chars")


QUERIES = {"p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p6_totals": p6_totals}
ORACLES: dict[str, str] = {}
