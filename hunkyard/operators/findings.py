"""Review findings: validity of responses, choice of attempts, roll-ups, order of importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severities from mild to grave, and the least confidence that is kept.
SEVERITIES = ["low", "medium", "high", "critical"]
LEAST_CONFIDENCE = 0.55
INLINE = ["critical", "high"]
PRIORITY = ["critical", "high", "medium"]
FALLBACK_ISSUES = 5
ATTEMPTS = 3


def severity_rank(c: Column) -> Column:
    """0 for low up to 3 for critical; any other value counts as 0."""
    return F.greatest(F.array_position(F.array(*map(F.lit, SEVERITIES)), c) - 1, F.lit(0)).cast("int")


def urgency(c: Column) -> Column:
    """0 for critical down to 3 for low, 99 for any other value."""
    return F.when(c.isin(*SEVERITIES), 3 - severity_rank(c)).otherwise(99).cast("int")


def risk_level(ranks: Column) -> Column:
    """The name of the greatest rank of a group, ``low`` for an empty one."""
    return F.try_element_at(F.array(*map(F.lit, SEVERITIES)), F.coalesce(F.max(ranks), F.lit(0)) + 1)


def validate(findings: DataFrame, keys: list[str], ok: Column, threshold: float = LEAST_CONFIDENCE) -> DataFrame:
    """One row for each response: whether it is valid, findings kept and dropped, its risk.

    One finding that is not ``ok`` (null counts as not) makes the response invalid, and so does a response none of whose
    findings reaches the threshold. Risk is that of the kept findings of a valid response.
    """
    kept = F.coalesce(F.col("confidence") >= threshold, F.lit(False))
    g = findings.withColumn("kept", kept).withColumn("ok", F.coalesce(ok, F.lit(False))).groupBy(*keys).agg(F.bool_and("ok").alias("all_ok"), F.count_if("kept").alias("retained"), F.count_if(~F.col("kept")).alias("dropped"), risk_level(F.when(F.col("kept"), severity_rank(F.col("severity")))).alias("risk"))
    valid = F.col("all_ok") & (F.col("retained") > 0)
    return g.select(*keys, valid.alias("valid"), F.when(valid, F.col("retained")).otherwise(0).alias("retained"), F.when(valid, F.col("dropped")).otherwise(0).alias("dropped"), F.when(valid, F.col("risk")).otherwise("low").alias("risk_level"))


def choose_attempt(responses: DataFrame, keys: list[str], attempt: str = "attempt", most: int = ATTEMPTS) -> DataFrame:
    """The first valid attempt of each key among the first ``most``, or null, with the attempts made until then."""
    g = responses.where(F.col(attempt) < most).groupBy(*keys).agg(F.min(F.when(F.col("valid"), F.col(attempt))).alias("chosen"), F.count("*").alias("present"))
    return g.select(*keys, "chosen", F.coalesce(F.col("chosen") + 1, F.col("present")).cast("bigint").alias("tried"))


def rollup(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of each key by severity, with the short text ``n (h high)`` of a summary table."""
    g = findings.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES), risk_level(severity_rank(F.col("severity"))).alias("risk_level"))
    high = F.col("high") + F.col("critical")
    return g.withColumn("cell", F.when(high > 0, F.concat(F.col("n").cast("string"), F.lit(" ("), high.cast("string"), F.lit(" high)"))).otherwise(F.col("n").cast("string")))


def prioritize(findings: DataFrame, keys: list[str], order: str, fallback: int = FALLBACK_ISSUES) -> DataFrame:
    """The issues to fix of each key: all of medium severity or worse, or else the first few of its list.

    The list is sorted by urgency; equal ones keep their order. Only that fallback needs a rank, of the rows of keys
    without any urgent finding.
    """
    urgent = findings.where(F.col("severity").isin(*PRIORITY))
    rest = findings.join(urgent.select(*keys).distinct(), keys, "left_anti")
    w = Window.partitionBy(*keys).orderBy(urgency(F.col("severity")), order)
    first = rest.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= fallback).drop("__n")
    return urgent.unionByName(first).withColumn("urgency", urgency(F.col("severity")))


def inline(findings: DataFrame) -> DataFrame:
    """Findings fit for a comment at their line: grave ones whose line is known and not 0."""
    return findings.where(F.col("severity").isin(*INLINE) & F.col("line").isNotNull() & (F.col("line") != 0))


def finding_key(source: Column, line: Column, *texts: Column) -> Column:
    """``source:line:hash`` with ``?`` for an unknown line; null without any text."""
    text = F.concat_ws(" ", *(F.when(t != "", t) for t in texts))
    key = F.concat_ws(":", source, F.coalesce(line.cast("string"), F.lit("?")), F.substring(F.md5(text), 1, 8))
    return F.when(F.regexp_replace(text, r"[\s\p{Z}]", "") != "", key)


def unite(results: dict[str, DataFrame], error: str = "error") -> DataFrame:
    """The findings of several reviewers in one shape, with their ``source``; columns that one lacks are null.

    A result with an ``error`` column loses the rows in which it is set, and nothing else fails with them.
    """
    out: DataFrame | None = None
    for name, df in results.items():
        part = df.where(F.col(error).isNull()).drop(error) if error in df.columns else df
        part = part.withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no results to unite")
    return out


def distinct_evidence(evidence: DataFrame, order: str = "rank") -> DataFrame:
    """Evidence without repeated pairs of finding and clause, the first of each by ``order``."""
    rest = [c for c in evidence.columns if c not in ("finding_key", "clause_id")]
    g = evidence.groupBy("finding_key", "clause_id").agg(F.min(F.struct(order, *(c for c in rest if c != order))).alias("v"))
    return g.select("finding_key", "clause_id", *(F.col(f"v.{c}").alias(c) for c in rest)).select(*evidence.columns)
