"""Queries of problem 7: training mixes with target shares of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hunkyard.llm.bpe import encode
from hunkyard.llm.mixing import emit, rates, shares
from hunkyard.session import durable
from hunkyard.sources.tables import table


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """Document, source and tokens; written once, as both the rates and the draw need it."""
    return durable(encode(table(spark, d, "documents"), "doc_id", "text", others=("source",), counts=True))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every copy of every document of every mix."""
    n = _sizes(spark, d)
    return emit(n, rates(n, table(spark, d, "mix_targets"), whole=True))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of every source that a mix asks for, those without documents included."""
    n = _sizes(spark, d)
    targets = table(spark, d, "mix_targets")
    r = rates(n, targets, whole=True)
    return shares(emit(n, r), r, targets)


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares}
ORACLES: dict[str, str] = {}
