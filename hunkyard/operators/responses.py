"""Raw answers of reviewers, read as schema-checked findings.

A missing key takes its default, a key that is null does not; one bad finding makes the whole answer invalid. The
variant type keeps the two apart inside Spark, without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkyard.operators import findings as N

CATEGORIES = ["correctness", "security", "maintainability", "policy"]
DEFAULT_CONFIDENCE = 0.8


def json_object(text: Column) -> Column:
    """The JSON text inside an answer: of the first fence, else the whole, else from the first to the last brace; null if none parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(F.rlike(text, F.lit(r"(?s)```(?:json)?\s*.*?```")), F.regexp_replace(fenced, r"^\s+|\s+$", "")).otherwise(text)
    braces = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull() & (F.trim(c) != ""), c)
    return F.coalesce(ok(body), ok(braces))


def _get(v: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def _absent(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant").isNull()


def parse_responses(responses: DataFrame, keys: list[str], agent: str, text: str, threshold: float = N.LEAST_CONFIDENCE) -> DataFrame:
    """``keys, valid, findings, dropped, risk_level`` of each answer; ``findings`` holds those of enough confidence.

    An answer is valid if it is an object, its findings are a list or missing, every finding is in order and, if there
    are any, one reaches the threshold. The stated risk holds unless it is low; then that of the findings counts.
    """
    r = responses.select(*keys, F.col(agent).alias("agent"), json_object(F.col(text)).alias("body")).withColumn("v", F.try_parse_json("body"))
    kind = F.schema_of_variant("v")
    r = r.withColumn("is_object", F.coalesce(kind.startswith("OBJECT"), F.lit(False)))
    listed = F.try_variant_get("v", "$.findings", "array<variant>")
    r = r.withColumn("list_ok", F.col("is_object") & (_absent(F.col("v"), "findings") | listed.isNotNull()))
    r = r.withColumn("items", F.when(F.col("list_ok"), F.coalesce(listed, F.from_json(F.lit("[]"), "array<variant>"))))

    def one(f: Column) -> Column:
        sev, cat, msg, conf = (_get(f, k, t) for k, t in (("severity", "string"), ("category", "string"), ("message", "string"), ("confidence", "double")))
        conf_ok = _absent(f, "confidence") | (F.schema_of_variant(F.try_variant_get(f, "$.confidence", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL)") & conf.between(0, 1))
        ok = (
            F.schema_of_variant(f).startswith("OBJECT")
            & (F.trim(F.coalesce(msg, F.lit(""))) != "")
            & (_absent(f, "severity") | F.coalesce(sev.isin(*N.SEVERITIES), F.lit(False)))
            & (_absent(f, "category") | F.coalesce(cat.isin(*CATEGORIES), F.lit(False)))
            & F.coalesce(conf_ok, F.lit(False))
        )
        hint = F.coalesce(_get(f, "recommendation", "string"), _get(f, "fix", "string"), _get(f, "suggestion", "string"), _get(f, "remediation", "string"), F.lit(""))
        return F.struct(
            F.coalesce(ok, F.lit(False)).alias("ok"),
            F.coalesce(cat, F.col("agent")).alias("category"),
            F.coalesce(_get(f, "type", "string"), F.lit("other")).alias("type"),
            F.coalesce(sev, F.lit("medium")).alias("severity"),
            F.coalesce(conf, F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
            _get(f, "line", "int").alias("line"),
            F.trim(msg).alias("message"),
            hint.alias("recommendation"),
        )

    r = r.withColumn("all", F.transform("items", one))
    enough = F.filter("all", lambda x: x["confidence"] >= threshold)
    valid = F.coalesce(F.col("list_ok") & F.forall("all", lambda x: x["ok"]) & ((F.size("all") == 0) | (F.size(enough) > 0)), F.lit(False))
    rank = F.array_max(F.transform(enough, lambda x: N.severity_rank(x["severity"])))
    found = F.get(F.array(*map(F.lit, N.SEVERITIES)), F.coalesce(rank, F.lit(0)))
    stated = _get(F.col("v"), "risk_level", "string")
    risk = F.when(valid & stated.isNotNull() & (stated != "low"), stated).when(valid, found).otherwise("low")
    none = F.filter("all", lambda x: F.lit(False))
    return r.select(*keys, valid.alias("valid"), F.when(valid, enough).otherwise(none).alias("findings"), F.when(valid, F.size("all") - F.size(enough)).otherwise(0).alias("dropped"), risk.alias("risk_level"))


def parse_plans(responses: DataFrame, keys: list[str], text: str, path: Column) -> DataFrame:
    """``keys, parsed, patches, affected_callers, confidence`` of each raw plan of changes.

    A patch without a path has ``path``, one without lines stands at 0; a patch whose line is null or no number is left
    out, and nothing else fails with it. A plan that is no object has no patches, and the usual confidence.
    """
    r = responses.withColumn("v", F.try_parse_json(json_object(F.col(text))))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    items = F.coalesce(F.try_variant_get("v", "$.patches", "array<variant>"), F.from_json(F.lit("[]"), "array<variant>"))

    def line(x: Column, key: str) -> Column:
        return F.when(_absent(x, key), F.lit(0)).otherwise(_get(x, key, "string").try_cast("int"))

    def one(x: Column) -> Column:
        texts = [F.coalesce(_get(x, k, "string"), F.lit("")).alias(k) for k in ("original_snippet", "patched_snippet", "description")]
        return F.struct(F.coalesce(_get(x, "file_path", "string"), path).alias("file_path"), *texts, line(x, "start_line").alias("start_line"), line(x, "end_line").alias("end_line"))

    patches = F.filter(F.transform(items, one), lambda x: x["start_line"].isNotNull() & x["end_line"].isNotNull())
    callers = F.coalesce(F.try_variant_get("v", "$.affected_callers", "array<string>"), F.array().cast("array<string>"))
    return r.select(*keys, is_object.alias("parsed"), patches.alias("patches"), callers.alias("affected_callers"), F.coalesce(F.try_variant_get("v", "$.confidence", "double"), F.lit(DEFAULT_CONFIDENCE)).alias("confidence"))


def first_valid(parsed: DataFrame, keys: list[str], attempt: str, most: int = N.ATTEMPTS) -> DataFrame:
    """The first valid answer of each key among the first attempts; without one, an empty result marked by ``error``."""
    some = parsed.where(F.col(attempt) < most)
    best = some.where("valid").groupBy(*keys).agg(F.min_by(F.struct("findings", "dropped", "risk_level", F.col(attempt).alias("attempt")), attempt).alias("b"))
    every = some.select(*keys).distinct()
    return every.join(best, keys, "left").select(*keys, F.col("b.findings").alias("findings"), F.coalesce("b.dropped", F.lit(0)).alias("dropped"), F.coalesce("b.risk_level", F.lit("low")).alias("risk_level"), F.col("b.attempt").alias("attempt"), F.col("b").isNull().alias("error"))
