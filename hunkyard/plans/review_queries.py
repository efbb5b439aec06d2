"""Queries on findings, evidence, snippets, markers, traces and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkyard.operators import findings as N
from hunkyard.operators import locate as L
from hunkyard.operators import review_state as R
from hunkyard.operators.responses import parse_responses
from hunkyard.operators.retrieve import nearest
from hunkyard.plans.diff_queries import _PL, sql_lines
from hunkyard.sources.tables import table
from hunkyard.streaming.queue import queue_state as queue_states

CONTEXT_RELEVANCE = 0.25
SCAN_RELEVANCE = 0.2
EVIDENCE_RELEVANCE = 0.30
SCANNED_DOMAINS = [0, 1, 2, 3, 4]


def _findings(spark: SparkSession, d: str) -> DataFrame:
    """Events read as findings: kind, severity and confidence from type and payload."""
    k = F.get_json_object("props", "$.k").cast("int")
    t = F.col("event_type")
    category = F.when(t == "error", "correctness").when(t == "purchase", "security").when(t == "click", "maintainability").when(t == "view", "policy").otherwise("other")
    sev = F.get(F.array(*map(F.lit, ["critical", "high", "medium", "low", "unknown"])), F.pmod(k, F.lit(5)))
    return table(spark, d, "events").select("event_id", "user_id", (F.col("event_id") % 3).alias("attempt"), category.alias("category"), sev.alias("severity"), (k / 100).alias("confidence"), k.alias("line"))


def finding_validate(spark: SparkSession, d: str) -> DataFrame:
    return N.validate(_findings(spark, d), ["user_id", "attempt"], F.col("line") <= 98)


def response_parse(spark: SparkSession, d: str) -> DataFrame:
    """Events written as raw answers, fenced or in prose, and read back under the schema."""
    f = _findings(spark, d)
    body = F.concat(F.lit('{"findings": [{"message": "'), F.col("category"), F.lit('", "severity": "'), F.col("severity"), F.lit('", "confidence": '), F.when(F.col("line") % 10 == 0, "null").otherwise(F.col("confidence").cast("string")), F.lit("}]}"))
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("I found "), body))
    p = parse_responses(f.select("event_id", F.lit("security").alias("agent"), text.alias("text")), ["event_id"], "agent", "text")
    return p.select("event_id", "valid", F.size("findings").cast("bigint").alias("kept"), "risk_level")


def attempt_select(spark: SparkSession, d: str) -> DataFrame:
    return N.choose_attempt(finding_validate(spark, d), ["user_id"])


def severity_rollup(spark: SparkSession, d: str) -> DataFrame:
    return N.rollup(_findings(spark, d), ["user_id", "category"])


def issue_priority(spark: SparkSession, d: str) -> DataFrame:
    return N.prioritize(_findings(spark, d), ["user_id"], "event_id").select("user_id", "event_id", "severity", "urgency")


def inline_select(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("file_path"))
    return N.inline(_findings(spark, d)).join(c, "user_id", "left").select("event_id", "file_path", "severity", "line")


def finding_key(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select("doc_id", N.finding_key(F.coalesce("source", F.lit("")), F.col("pr"), F.col("text")).alias("finding_key"))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every hundredth vector asks, against all rows."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("domain"), "embedding")
    return v.where("id % 100 = 0"), v


def _ranked(df: DataFrame, least: float, strict: bool) -> DataFrame:
    ok = F.col("score") > least if strict else F.col("score") >= least
    return df.where(ok).select("query_id", "clause_id", "rank", "score")


def broad_retrieve(spark: SparkSession, d: str) -> DataFrame:
    q, c = _vectors(spark, d)
    return _ranked(nearest(q, c, 8), CONTEXT_RELEVANCE, True)


def evidence_topk(spark: SparkSession, d: str) -> DataFrame:
    q, c = _vectors(spark, d)
    return _ranked(nearest(q, c, 3, same_domain=True), EVIDENCE_RELEVANCE, False)


def risk_scan(spark: SparkSession, d: str) -> DataFrame:
    q, c = _vectors(spark, d)
    return _ranked(nearest(q, c.where(F.col("domain").isin(SCANNED_DOMAINS)), 10), SCAN_RELEVANCE, True)


def evidence_stats(spark: SparkSession, d: str) -> DataFrame:
    """Queries processed, those with evidence, pieces of evidence and distinct clauses, per domain of the query."""
    q, c = _vectors(spark, d)
    e = _ranked(nearest(q, c, 3, same_domain=True), EVIDENCE_RELEVANCE, False).select(F.col("query_id").alias("id"), "clause_id")
    j = q.select("id", "domain").join(e, "id", "left")
    return j.groupBy("domain").agg(F.countDistinct("id").alias("processed"), F.countDistinct(F.when(F.col("clause_id").isNotNull(), F.col("id"))).alias("with_evidence"), F.count("clause_id").alias("pieces"), F.countDistinct("clause_id").alias("clauses"))


def policy_join(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the raters' opinions on them, kept without any; opinions seen and found abusive, per source."""
    o = table(spark, d, "labels").select("doc_id", "toxic")
    j = table(spark, d, "documents").select("doc_id", "source").join(o, "doc_id", "left")
    return j.groupBy("source").agg(F.countDistinct("doc_id").alias("documents"), F.count("toxic").alias("scanned"), F.count_if(F.col("toxic") == 1).alias("violated"))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    """The latest delivery of each changed file that patches refer to."""
    f = table(spark, d, "diff_files").where("repo is not null and pr is not null and file_path is not null")
    return f.groupBy("repo", "pr", "file_path").agg(F.max(F.struct("fetched_at", "diff_id")).alias("v")).select("repo", "pr", "file_path", "v.diff_id")


def _patches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "patches").join(_targets(spark, d), ["repo", "pr", "file_path"])


def snippet_locate(spark: SparkSession, d: str) -> DataFrame:
    s = _patches(spark, d).select(F.col("patch_id").alias("snippet_id"), "diff_id", F.col("original_snippet").alias("code"))
    return L.locate(s, table(spark, d, "diff_files").select("diff_id", "patch", "full_content")).withColumnRenamed("snippet_id", "patch_id")


def patch_first(spark: SparkSession, d: str) -> DataFrame:
    p = _patches(spark, d).join(table(spark, d, "diff_files").select("diff_id", "full_content"), "diff_id")
    state, new = L.apply_first(F.col("full_content"), F.col("original_snippet"), F.col("patched_snippet"))
    return p.where("full_content is not null").select("patch_id", state.alias("state"), F.md5(new).alias("new_md5"))


def patch_apply(spark: SparkSession, d: str) -> DataFrame:
    """All patches of each file, applied one after the other."""
    p = _patches(spark, d).select("diff_id", "ord", F.col("original_snippet").alias("original"), F.col("patched_snippet").alias("patched"), "start_line")
    r = L.apply_patches(table(spark, d, "diff_files").where("full_content is not null"), p)
    return r.select("diff_id", "applied", "warned", F.md5("new_content").alias("new_md5"))


def _comments(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    head = F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8)
    mode = F.when(F.col("o_orderstatus") == "P", "incremental").otherwise("full")
    mark = R.build_marker(F.concat(F.lit("r/"), F.col("o_orderstatus")), F.col("o_custkey"), head, mode, F.when(F.col("o_orderstatus") == "P", "base"))
    return o.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority", head.alias("head"), R.append_marker(F.concat(F.lit("Report "), F.col("o_orderpriority")), mark).alias("body"))


def marker_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    m = _comments(spark, d).withColumn("m", R.parse_marker(F.col("body")))
    return m.select("o_orderkey", "body", F.try_element_at("m", F.lit("head")).alias("head"), F.try_element_at("m", F.lit("pr")).alias("pr"), F.try_element_at("m", F.lit("base")).alias("base"), F.size("m").cast("bigint").alias("n_keys"))


def latest_review(spark: SparkSession, d: str) -> DataFrame:
    return R.latest(_comments(spark, d), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "head"])


def commit_summary(spark: SparkSession, d: str) -> DataFrame:
    """The first commits of each customer as lines; merges are left out."""
    c = _comments(spark, d).where("o_orderstatus <> 'P'")
    line = F.concat(F.lit("- `"), F.col("head"), F.lit("` "), F.substring("o_orderpriority", 1, R.MESSAGE_CHARS))
    return R.listed(c, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], line)


def trace_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.trace_summary(table(spark, d, "spans"))


def chunk_report(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of each pull request as Markdown lines, the first twenty by id."""
    c = table(spark, d, "review_chunks").where("chunk_id is not null").groupBy("repo", "pr", "chunk_id").agg(F.max("file_path").alias("file_path"), F.max("token_count").alias("t"))
    line = F.concat(F.lit("- `"), F.col("file_path"), F.lit("`: "), F.coalesce(F.col("t").cast("string"), F.lit("?")), F.lit(" tokens"))
    return R.listed(c, ["repo", "pr"], [F.col("chunk_id")], line)


def index_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Files, texts and the sorted languages of each repository, joined by +."""
    s = table(spark, d, "source_files")
    return s.groupBy("repo").agg(F.countDistinct("path").alias("files"), F.count("content").alias("texts"), F.array_join(F.array_sort(F.collect_set(F.lower("language"))), "+").alias("languages"))


def base64_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts as a host's blobs and back, with the length of the blob."""
    t = table(spark, d, "documents").where("text is not null").withColumn("blob", F.regexp_replace(F.base64(F.encode("text", "utf-8")), r"\s", ""))
    return t.select("doc_id", F.length("blob").cast("bigint").alias("blob_chars"), (F.decode(F.unbase64("blob"), "utf-8") == F.col("text")).alias("same"))


def json_extract(spark: SparkSession, d: str) -> DataFrame:
    """The object of a response wrapped in prose or a fence, and its value."""
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```"))).otherwise(F.concat(F.lit("Result "), F.col("props"), F.lit(" done")))
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", F.trim(F.regexp_replace(fenced, r"\s+$", ""))).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    return table(spark, d, "events").select("event_id", F.get_json_object(body, "$.k").cast("int").alias("k"))


def upsert_plan(spark: SparkSession, d: str) -> DataFrame:
    """What publishing a report for each customer does: update the latest comment, or insert one."""
    prev = R.latest(_comments(spark, d).where("o_orderstatus <> 'O'"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey"])
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return c.join(prev, "o_custkey", "left").select("o_custkey", F.when(F.col("o_orderkey").isNull(), "insert").otherwise("update").alias("action"), F.col("o_orderkey").alias("comment_id"))


def _ops(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    op: Column = F.when(t == "signup", "enqueue").when(t == "click", "dequeue").when(t == "purchase", "complete").when(t == "error", "fail")
    return table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), op.alias("op")).where("op is not null")


def queue_state(spark: SparkSession, d: str) -> DataFrame:
    return queue_states(_ops(spark, d))


def push_join(spark: SparkSession, d: str) -> DataFrame:
    """Pushes to branches joined with the open requests of the branch."""
    e = table(spark, d, "events").where("event_type = 'click'").select("event_id", F.col("user_id").alias("o_custkey"))
    o = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey")
    return e.join(o, "o_custkey")


QUERIES = {
    f.__name__: f
    for f in (finding_validate, response_parse, attempt_select, severity_rollup, issue_priority, inline_select, finding_key, broad_retrieve, evidence_topk, risk_scan, evidence_stats, snippet_locate, patch_first, patch_apply, marker_roundtrip, latest_review, commit_summary, trace_summary, chunk_report, policy_join, index_sizes, base64_round_trip, json_extract, upsert_plan, queue_state, push_join)
}

_F = """f AS (SELECT event_id, user_id, event_id % 3 AS attempt, CASE event_type WHEN 'error' THEN 'correctness' WHEN 'purchase' THEN 'security' WHEN 'click' THEN 'maintainability' WHEN 'view' THEN 'policy' ELSE 'other' END AS category,
 ['critical', 'high', 'medium', 'low', 'unknown'][json_extract_string(props, '$.k')::INT % 5 + 1] AS severity, json_extract_string(props, '$.k')::INT / 100 AS confidence, json_extract_string(props, '$.k')::INT AS line FROM events)"""
_RANK = "CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"
_URGENCY = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 99 END"
_LEVEL = "['low', 'medium', 'high', 'critical']"
_V = f"""{_F}, v0 AS (SELECT user_id, attempt, bool_and(line <= 98) AS ok, count(*) FILTER (confidence >= {N.LEAST_CONFIDENCE}) AS r, count(*) FILTER (confidence < {N.LEAST_CONFIDENCE}) AS dr,
 coalesce(max({_RANK}) FILTER (confidence >= {N.LEAST_CONFIDENCE}), 0) AS rk FROM f GROUP BY 1, 2),
v AS (SELECT user_id, attempt, ok AND r > 0 AS valid, CASE WHEN ok AND r > 0 THEN r ELSE 0 END AS retained, CASE WHEN ok AND r > 0 THEN dr ELSE 0 END AS dropped, CASE WHEN ok AND r > 0 THEN {_LEVEL}[rk + 1] ELSE 'low' END AS risk_level FROM v0)"""


def _near(k: int, least: str, same: bool = False, where: str = "true") -> str:
    return f"""n0 AS (SELECT q.vec_id AS query_id, c.vec_id AS clause_id, greatest(round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6), 0) AS score
 FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND {where}{" AND q.label = c.label" if same else ""}),
n AS (SELECT query_id, clause_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, clause_id) AS rank FROM n0) WHERE rank <= {k} AND score {least})"""


_TARGETS = """tg AS (SELECT * FROM (SELECT repo, pr, file_path, diff_id, row_number() OVER (PARTITION BY repo, pr, file_path ORDER BY fetched_at DESC NULLS LAST, diff_id DESC) AS rn FROM diff_files) WHERE rn = 1),
pt AS (SELECT p.*, tg.diff_id FROM patches p JOIN tg ON tg.repo = p.repo AND tg.pr = p.pr AND tg.file_path = p.file_path)"""
_WS = "[\\s\\x0b\\p{Z}]"
_TRIM = lambda e: f"regexp_replace(regexp_replace({e}, '^{_WS}+', ''), '{_WS}+$', '')"
_NORMAL = lambda e: f"CASE WHEN regexp_matches({_TRIM(e)}, '^[+-]') THEN {_TRIM(_TRIM(e) + '[2:]')} ELSE {_TRIM(e)} END"
_C = """c AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus, o_orderpriority, md5(o_orderkey::VARCHAR)[1:8] AS head,
 'Report ' || o_orderpriority || chr(10) || chr(10) || '<!-- review-state repo=r/' || o_orderstatus || ' pr=' || o_custkey || ' head=' || md5(o_orderkey::VARCHAR)[1:8] || ' mode=' || CASE WHEN o_orderstatus = 'P' THEN 'incremental base=base' ELSE 'full' END || ' -->' AS body FROM orders)"""


def _listed(source: str, keys: str, order: str, line: str, most: int = R.LISTED_COMMITS) -> str:
    return f"""r AS (SELECT {keys}, {line} AS line, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS n FROM {source})
SELECT {keys}, count(*) AS n, string_agg(line, chr(10) ORDER BY n) FILTER (n <= {most}) || CASE WHEN count(*) > {most} THEN chr(10) || '... and ' || (count(*) - {most}) || ' more' ELSE '' END AS text FROM r GROUP BY {keys}"""


ORACLES = {
    "finding_validate": f"WITH {_V} SELECT * FROM v",
    "response_parse": f"""WITH {_F}, g AS (SELECT event_id, severity, line % 10 <> 0 AND severity <> 'unknown' AND confidence >= {N.LEAST_CONFIDENCE} AS valid FROM f)
 SELECT event_id, valid, valid::BIGINT AS kept, CASE WHEN valid THEN severity ELSE 'low' END AS risk_level FROM g""",
    "attempt_select": f"WITH {_V} SELECT user_id, min(attempt) FILTER (valid) AS chosen, coalesce(min(attempt) FILTER (valid) + 1, count(*))::BIGINT AS tried FROM v GROUP BY 1",
    "severity_rollup": f"""WITH {_F}, g AS (SELECT user_id, category, count(*) AS n, {", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in N.SEVERITIES)}, {_LEVEL}[max({_RANK}) + 1] AS risk_level FROM f GROUP BY 1, 2)
 SELECT *, CASE WHEN high + critical > 0 THEN n || ' (' || (high + critical) || ' high)' ELSE n::VARCHAR END AS cell FROM g""",
    "issue_priority": f"""WITH {_F}, u AS (SELECT *, {_URGENCY} AS urgency, bool_or(severity IN ('critical', 'high', 'medium')) OVER (PARTITION BY user_id) AS any_urgent FROM f),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY urgency, event_id) AS n FROM u)
 SELECT user_id, event_id, severity, urgency FROM r WHERE CASE WHEN any_urgent THEN severity IN ('critical', 'high', 'medium') ELSE n <= {N.FALLBACK_ISSUES} END""",
    "inline_select": f"WITH {_F} SELECT event_id, c_name AS file_path, severity, line FROM f LEFT JOIN customer ON c_custkey = user_id WHERE severity IN ('critical', 'high') AND line <> 0",
    "finding_key": f"SELECT doc_id, CASE WHEN regexp_replace(text, '{_WS}', '', 'g') <> '' THEN coalesce(source, '') || ':' || coalesce(pr::VARCHAR, '?') || ':' || md5(text)[1:8] END AS finding_key FROM documents",
    "broad_retrieve": f"WITH {_near(8, f'> {CONTEXT_RELEVANCE}')} SELECT * FROM n",
    "evidence_topk": f"WITH {_near(3, f'>= {EVIDENCE_RELEVANCE}', True)} SELECT * FROM n",
    "risk_scan": f"WITH {_near(10, f'> {SCAN_RELEVANCE}', where=f'c.label IN {tuple(SCANNED_DOMAINS)}')} SELECT * FROM n",
    "evidence_stats": f"""WITH {_near(3, f'>= {EVIDENCE_RELEVANCE}', True)} SELECT label AS domain, count(DISTINCT vec_id) AS processed, count(DISTINCT query_id) AS with_evidence, count(clause_id) AS pieces, count(DISTINCT clause_id) AS clauses
 FROM embeddings e LEFT JOIN n ON n.query_id = e.vec_id WHERE vec_id % 100 = 0 GROUP BY 1""",
    "snippet_locate": f"""WITH {_PL}, {_TARGETS},
nd AS (SELECT patch_id, diff_id, list_filter(list_transform({sql_lines("original_snippet")}, lambda x: {_NORMAL("x")}), lambda x: x <> '') AS find FROM pt),
hay AS (SELECT diff_id, hunk_no, min(new_line) AS first, list({_NORMAL("CASE WHEN line[1:1] IN ('+', ' ') THEN line[2:] ELSE line END")} ORDER BY new_line) AS h FROM num WHERE kind IN ('+', ' ') GROUP BY 1, 2),
hit AS (SELECT patch_id, hunk_no, first, len(find) AS m, list_filter(range(1, len(h) - len(find) + 2), lambda i: h[i:i + len(find) - 1] = find)[1] AS at0 FROM nd JOIN hay ON hay.diff_id = nd.diff_id WHERE len(find) > 0),
best AS (SELECT patch_id, first + at0 - 1 AS s, m FROM (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY hunk_no) AS rn FROM hit WHERE at0 IS NOT NULL) WHERE rn = 1),
wh AS (SELECT diff_id, list_transform({sql_lines("full_content")}, lambda x: {_NORMAL("x")}) AS h FROM diff_files),
rest AS (SELECT patch_id, len(find) AS m, list_filter(range(1, len(h) - len(find) + 2), lambda i: h[i:i + len(find) - 1] = find)[1] AS s FROM nd JOIN wh ON wh.diff_id = nd.diff_id WHERE len(find) > 0 AND patch_id NOT IN (SELECT patch_id FROM best))
SELECT patch_id, s::BIGINT AS start_line, (s + m - 1)::BIGINT AS end_line, 'diff_hunk' AS source FROM best UNION ALL SELECT patch_id, s::BIGINT, (s + m - 1)::BIGINT, 'full_content' FROM rest WHERE s IS NOT NULL""",
    "patch_first": f"""WITH {_TARGETS}, x AS (SELECT patch_id, full_content AS code, {_TRIM("coalesce(original_snippet, '')")} AS o, {_TRIM("coalesce(patched_snippet, '')")} AS p FROM pt JOIN (SELECT diff_id AS di, full_content FROM diff_files WHERE full_content IS NOT NULL) ON di = diff_id),
 y AS (SELECT *, position(o IN code) AS w FROM x)
 SELECT patch_id, CASE WHEN o = '' THEN 'empty' WHEN o = p THEN 'no change' WHEN w > 0 THEN 'applied' ELSE 'not found' END AS state, CASE WHEN o <> '' AND o <> p AND w > 0 THEN md5(code[1:w - 1] || p || code[w + length(o):]) END AS new_md5 FROM y""",
    "marker_roundtrip": f"WITH {_C} SELECT o_orderkey, body, head, o_custkey::VARCHAR AS pr, CASE WHEN o_orderstatus = 'P' THEN 'base' END AS base, CASE WHEN o_orderstatus = 'P' THEN 5 ELSE 4 END::BIGINT AS n_keys FROM c",
    "latest_review": f"WITH {_C} SELECT o_custkey, o_orderkey, head FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM c) WHERE rn = 1",
    "commit_summary": f"WITH {_C}, m AS (SELECT * FROM c WHERE o_orderstatus <> 'P'), " + _listed("m", "o_custkey", "o_orderdate, o_orderkey", "'- `' || head || '` ' || o_orderpriority[1:60]"),
    "trace_summary": """WITH s AS (SELECT trace_id, lower(trim(span_id)) AS span, nullif(lower(trim(parent_id)), '') AS parent, exported_at, name, start_time, end_time, status FROM spans WHERE trim(span_id) <> ''),
 l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, span ORDER BY exported_at DESC NULLS LAST, parent DESC NULLS LAST, name DESC NULLS LAST, start_time DESC NULLS LAST, end_time DESC NULLS LAST, status DESC NULLS LAST) AS rn FROM s) WHERE rn = 1)
 SELECT trace_id, count(*) AS spans, count(*) FILTER (starts_with(name, 'llm.')) AS llm_calls, count(*) FILTER (status = 'error') AS errors, round(max(CASE WHEN parent IS NULL THEN end_time - start_time END) * 1000, 1) AS root_ms FROM l GROUP BY 1""",
    "chunk_report": "WITH m AS (SELECT repo, pr, chunk_id, max(file_path) AS file_path, max(token_count) AS t FROM review_chunks WHERE chunk_id IS NOT NULL GROUP BY 1, 2, 3), " + _listed("m", "repo, pr", "chunk_id", "'- `' || file_path || '`: ' || coalesce(t::VARCHAR, '?') || ' tokens'"),
    "policy_join": "SELECT source, count(DISTINCT doc_id) AS documents, count(toxic) AS scanned, count(*) FILTER (toxic = 1) AS violated FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "index_sizes": "SELECT repo, count(DISTINCT path) AS files, count(content) AS texts, coalesce(string_agg(DISTINCT lower(language), '+' ORDER BY lower(language)), '') AS languages FROM source_files GROUP BY 1",
    "base64_round_trip": "SELECT doc_id, length(to_base64(encode(text)))::BIGINT AS blob_chars, true AS same FROM documents WHERE text IS NOT NULL",
    "json_extract": "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events",
    "upsert_plan": f"""WITH {_C}, p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM c WHERE o_orderstatus <> 'O') WHERE rn = 1)
 SELECT c_custkey AS o_custkey, CASE WHEN o_orderkey IS NULL THEN 'insert' ELSE 'update' END AS action, o_orderkey AS comment_id FROM customer LEFT JOIN p ON p.o_custkey = c_custkey""",
    "queue_state": """WITH o AS (SELECT user_id AS task_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'click' THEN 'dequeue' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' END AS op FROM events WHERE event_type <> 'view'),
 c AS (SELECT *, sum((op = 'enqueue')::INT) OVER (PARTITION BY task_id ORDER BY seq) AS life FROM o),
 g AS (SELECT *, count(*) FILTER (op = 'fail') OVER (PARTITION BY task_id, life ORDER BY seq) AS fails FROM c),
 z AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) AS rn FROM g)
 SELECT task_id, CASE WHEN op = 'enqueue' THEN 'pending' WHEN op = 'dequeue' THEN 'processing' WHEN op = 'complete' THEN 'done' WHEN fails < 3 THEN 'pending' ELSE 'dead' END AS state, fails AS retry_count, seq AS last_seq FROM z WHERE rn = 1""",
    "push_join": "SELECT event_id, o_custkey, o_orderkey FROM events JOIN orders ON o_custkey = user_id WHERE event_type = 'click' AND o_orderstatus = 'O'",
}
