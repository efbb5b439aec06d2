"""Comments, commits and traces: markers, the latest of each key, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The name of the marker that a review leaves in a comment; pass another where comments already carry one.
MARKER_NAME = "review-state"
SHORT_SHA = 8
LISTED_COMMITS = 20
MESSAGE_CHARS = 60


def _pattern(name: str) -> str:
    return rf"(?s)<!--\s*\Q{name}\E(.*?)-->"


def build_marker(repo: Column, pr: Column, head: Column, mode: Column, base: Column | None = None, name: str = MARKER_NAME) -> Column:
    """The marker text; an empty or null head is ``unknown``, an empty or null base is left out."""
    parts = [F.lit(name), F.concat(F.lit("repo="), repo), F.concat(F.lit("pr="), pr.cast("string")), F.concat(F.lit("head="), F.coalesce(F.when(head != "", head), F.lit("unknown"))), F.concat(F.lit("mode="), mode)]
    if base is not None:
        parts.append(F.when(base != "", F.concat(F.lit("base="), base)))
    return F.concat(F.lit("<!-- "), F.concat_ws(" ", *parts), F.lit(" -->"))


def parse_marker(body: Column, name: str = MARKER_NAME) -> Column:
    """The marker's keys and values as a map: parts without = are dropped, quotes stripped, the last of a key wins."""
    inner = F.regexp_extract(F.coalesce(body, F.lit("")), _pattern(name), 1)
    parts = F.filter(F.split(F.trim(inner), r"\s+"), lambda x: F.instr(x, "=") > 0)
    pairs = F.transform(parts, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(F.substring(x, F.instr(x, "=") + 1, F.length(x)), '^"+|"+$', "").alias("v")))
    unique = F.aggregate(pairs, F.expr("cast(map() as map<string,string>)"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))
    return unique


def append_marker(body: Column, marker: Column, name: str = MARKER_NAME) -> Column:
    """The body with the marker at its end, in place of an earlier one."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), _pattern(name), ""), r"\s+$", "")
    return F.regexp_replace(F.concat(clean, F.lit("\n\n"), marker), r"^\s+|\s+$", "")


def latest(rows: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The row of each key with the greatest ``order``, by a partial aggregation instead of a sort of whole groups."""
    g = rows.groupBy(*keys).agg(F.max(F.struct(*order, *(c for c in keep if c not in order))).alias("v"))
    return g.select(*keys, *(F.col(f"v.{c}").alias(c) for c in keep))


def listed(rows: DataFrame, keys: list[str], order: list[Column], line: Column, most: int = LISTED_COMMITS) -> DataFrame:
    """The first ``most`` lines of each key as one text, with a last line that counts the rest."""
    w = Window.partitionBy(*keys).orderBy(*order)
    shown = rows.select(*keys, line.alias("__line"), F.row_number().over(w).alias("__n")).where(F.col("__n") <= most)
    text = shown.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__line"))), lambda x: x["__line"]), "\n").alias("text"))
    size = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    j = text.join(size, keys)
    return j.select(*keys, "n", F.when(F.col("n") > most, F.concat("text", F.lit("\n... and "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise(F.col("text")).alias("text"))


def trace_summary(spans: DataFrame) -> DataFrame:
    """Spans, model calls, errors and the duration of the longest root of each trace, in milliseconds.

    Of several exports of a span the latest counts, as in the hierarchy of spans.
    """
    from hunkyard.operators.hierarchy import clean_id

    s = spans.select("trace_id", clean_id(F.col("span_id")).alias("span"), clean_id(F.col("parent_id")).alias("parent"), "exported_at", "name", "start_time", "end_time", "status").where("span is not null")
    g = s.groupBy("trace_id", "span").agg(F.max(F.struct("exported_at", "parent", "name", "start_time", "end_time", "status")).alias("v")).select("trace_id", "v.*")
    root = F.when(F.col("parent").isNull(), F.col("end_time") - F.col("start_time"))
    return g.groupBy("trace_id").agg(F.count("*").alias("spans"), F.count_if(F.col("name").startswith("llm.")).alias("llm_calls"), F.count_if(F.col("status") == "error").alias("errors"), F.round(F.max(root) * 1000, 1).alias("root_ms"))
