"""Templates with overrides, and reports of test runs, as columns and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ERRORS = 10


def merge(templates: DataFrame) -> DataFrame:
    """``section, field, template``: of each field the override if there is one, else the default."""
    return templates.groupBy("section", "field").agg(F.max_by("template", F.col("is_override").cast("int")).alias("template"))


def render(template: Column, values: Column, extra: Column | None = None) -> Column:
    """The template with each ``{{ name }}`` replaced from the map ``values``, an unknown one by nothing, trimmed; then ``extra``."""
    names = F.array_distinct(F.regexp_extract_all(template, F.lit(r"(\{\{\s*[\w.]+\s*\}\})"), F.lit(1)))
    name = lambda x: F.regexp_extract(x, r"\{\{\s*([\w.]+)\s*\}\}", 1)
    out = F.aggregate(names, template, lambda t, x: F.replace(t, x, F.coalesce(F.try_element_at(values, name(x)), F.lit(""))))
    out = F.regexp_replace(F.coalesce(out, F.lit("")), r"^\s+|\s+$", "")
    if extra is None:
        return out
    more = F.regexp_replace(F.coalesce(extra, F.lit("")), r"^\s+|\s+$", "")
    return F.when((out != "") & (more != ""), F.concat(out, F.lit("\n\n"), more)).otherwise(out)


def test_report(text: Column) -> Column:
    """Total, failed and the first failures named in the text output of a test run; 0 and none for a null text."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r")
    count = lambda word: F.aggregate(lines, F.lit(0), lambda n, x: n + F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(x, rf"(\d+) {word}", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0)))
    failures = F.transform(F.filter(lines, lambda x: x.startswith("FAILED ")), lambda x: F.substring(F.trim(F.substring(x, 8, 100_000)), 1, 200))
    failed = count("failed")
    return F.struct((count("passed") + failed).alias("total"), (failed + count("error")).alias("failed"), F.slice(failures, 1, MOST_ERRORS).alias("errors"))
