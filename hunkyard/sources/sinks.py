"""Results written as files and merged into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, folder: str, by: list[str] | None = None) -> None:
    """Rows as JSON lines, a folder for each value of ``by``; text stays UTF-8."""
    w = df.write.mode("overwrite").option("ignoreNullFields", "false")
    (w.partitionBy(*by) if by else w).json(folder)


def trace_files(spans: DataFrame) -> DataFrame:
    """``file, trace_id, record``: one JSON record for each span, with the name of its trace's file."""
    return spans.select(F.concat(F.lit("trace-"), F.substring("trace_id", 1, 12), F.lit(".json")).alias("file"), "trace_id", F.to_json(F.struct(*spans.columns)).alias("record"))


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """``current`` with ``changes`` of the same columns: of each key the change with the greatest ``order`` wins.

    A merge by aggregation: no side is sorted or broadcast, and equal orders are settled by the greatest row.
    """
    cols = [c for c in current.columns if c != key]
    rest = [c for c in cols if c != order]
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.select(*current.columns).withColumn("__new", F.lit(1)))
    v = F.max(F.struct("__new", order, *rest)).alias("v")
    return both.groupBy(key).agg(v).select(key, *(F.col(f"v.{c}").alias(c) for c in cols)).select(*current.columns)


def publish_plan(reports: DataFrame, comments: DataFrame, keys: list[str]) -> DataFrame:
    """``reports`` with the action that publishing takes: update the comment of the same key, or insert one."""
    known = comments.select(*keys, F.col("id").alias("comment_id"))
    return reports.join(known, keys, "left").withColumn("action", F.when(F.col("comment_id").isNull(), "insert").otherwise("update"))
