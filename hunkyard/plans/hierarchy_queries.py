"""Queries of problem 1: the steps of a review, from parent links to hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkyard.operators.hierarchy import descendants, hierarchy
from hunkyard.sources.tables import table


def _spans(spark: SparkSession, d: str, with_path: bool) -> DataFrame:
    return hierarchy(table(spark, d, "spans"), "trace_id", "span_id", "parent_id", "exported_at", with_path)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d, False).select(F.col("ns").alias("trace_id"), F.col("id").alias("span_id"), "root_id", "depth")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d, True).select(F.col("ns").alias("trace_id"), F.col("id").alias("span_id"), "root_id", "depth", F.array_join("path", "/").alias("path"), "back_edge")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(_spans(spark, d, True)).select(F.col("ns").alias("trace_id"), F.col("id").alias("span_id"), F.col("descendant").alias("descendant_id"), "distance")


QUERIES = {"p1_found": p1_found, "p1_paths": p1_paths, "p1_descendants": p1_descendants}

_NODES = """
WITH RECURSIVE latest AS (
  SELECT trace_id, lower(trim(span_id)) AS span_id, nullif(lower(trim(parent_id)), '') AS parent_id,
         row_number() OVER (PARTITION BY trace_id, lower(trim(span_id))
                            ORDER BY exported_at DESC NULLS LAST, nullif(lower(trim(parent_id)), '') DESC NULLS LAST) AS rn
  FROM spans),
nodes AS (SELECT trace_id, span_id, parent_id FROM latest WHERE rn = 1),
linked AS (SELECT n.trace_id, n.span_id, p.span_id AS parent_id
           FROM nodes n LEFT JOIN nodes p ON p.trace_id = n.trace_id AND p.span_id = n.parent_id),
tree AS (SELECT trace_id, span_id, span_id AS root_id, 0 AS depth, span_id AS path FROM linked WHERE parent_id IS NULL
         UNION ALL
         SELECT l.trace_id, l.span_id, t.root_id, t.depth + 1, t.path || '/' || l.span_id
         FROM linked l JOIN tree t ON t.trace_id = l.trace_id AND t.span_id = l.parent_id),
lost AS (SELECT l.* FROM linked l ANTI JOIN tree t ON t.trace_id = l.trace_id AND t.span_id = l.span_id),
up AS (SELECT trace_id, span_id, parent_id AS cur FROM lost
       UNION
       SELECT u.trace_id, u.span_id, l.parent_id FROM up u JOIN lost l ON l.trace_id = u.trace_id AND l.span_id = u.cur),
on_circle AS (SELECT trace_id, span_id FROM up WHERE cur = span_id),
circle AS (SELECT u.trace_id, u.span_id, min(u.cur) AS root_id
           FROM up u JOIN on_circle c ON c.trace_id = u.trace_id AND c.span_id = u.cur GROUP BY 1, 2)
"""

ORACLES = {
    "p1_found": _NODES
    + """SELECT trace_id, span_id, root_id, depth::INTEGER AS depth FROM tree
UNION ALL SELECT trace_id, span_id, root_id, -1 FROM circle""",
    "p1_paths": _NODES
    + """SELECT trace_id, span_id, root_id, depth::INTEGER AS depth, path, false AS back_edge FROM tree
UNION ALL SELECT trace_id, span_id, root_id, -1, NULL, span_id = root_id FROM circle""",
    "p1_descendants": _NODES
    + """, pairs AS (SELECT trace_id, parent_id AS span_id, span_id AS descendant_id, 1 AS distance FROM linked SEMI JOIN tree USING (trace_id, span_id) WHERE parent_id IS NOT NULL
  UNION ALL SELECT l.trace_id, l.parent_id, p.descendant_id, p.distance + 1 FROM pairs p JOIN linked l ON l.trace_id = p.trace_id AND l.span_id = p.span_id WHERE l.parent_id IS NOT NULL)
SELECT trace_id, span_id, descendant_id, distance::INTEGER AS distance FROM pairs""",
}
