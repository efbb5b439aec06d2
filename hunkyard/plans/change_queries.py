"""Queries on changes as they come in and on the evidence for what is found in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkyard.functions import text as T
from hunkyard.functions.arrays import rows_of
from hunkyard.operators import diff as D
from hunkyard.operators import graph as G
from hunkyard.operators import symbols as S
from hunkyard.operators.responses import parse_plans
from hunkyard.operators.retrieve import nearest
from hunkyard.plans.diff_queries import ORACLES as DIFF_SQL
from hunkyard.plans.diff_queries import sql_first_match, sql_lookup
from hunkyard.plans.graph_queries import _DEPENDENTS, _dependencies_of, _symbols_of, sql_parsed
from hunkyard.session import durable, spread
from hunkyard.sources.tables import table

EVIDENCE_RELEVANCE = 0.30
# Reviewers whose findings are looked up in one domain only, here named by its number, and the one whose findings bring their own evidence.
SOURCES = ["security", "bug", "perf", "quality", "practice", "policy"]
DOMAIN_OF_SOURCE = {"security": 0, "practice": 1}
OWN_EVIDENCE = "policy"
# How much of a text is looked up, by the kind of search.
LOOKED_UP = {"broad": 2000, "precise": 1000, "scan": 3000}


def diff_split(spark: SparkSession, d: str) -> DataFrame:
    """Patches written as one diff text of two files, and taken apart again."""
    f = spread(table(spark, d, "diff_files").where("patch is not null and file_path is not null").select("diff_id", "file_path", "patch"))
    part = lambda p: F.concat(F.lit("diff --git a/"), p, F.lit(" b/"), p, F.lit("\n--- a/"), p, F.lit("\n+++ b/"), p, F.lit("\n"), F.col("patch"), F.lit("\n"))
    both = F.concat(part(F.col("file_path")), part(F.concat(F.lit("copy/"), F.col("file_path"))))
    s = D.split_diff(f.select("diff_id", both.alias("text")), ["diff_id"], "text")
    return s.select("diff_id", F.col("file_no").cast("bigint").alias("file_no"), "file_path", F.md5("patch").alias("patch_md5"))


def review_files(spark: SparkSession, d: str) -> DataFrame:
    """The changed files that a review takes in: not removed, not skipped by the provider, with added text; the text of a
    failed fetch is the added one. Those of a known language with numbered additions are reviewed."""
    f = spread(table(spark, d, "diff_files").select("diff_id", "file_path", "status", "patch", "full_content"))
    added = T.added_text(F.col("patch"))
    kept = f.where((F.coalesce("status", F.lit("")) != "removed") & T.first_match(F.col("file_path"), T.PROVIDER_SKIPPED).isNull())
    h = D.with_added(kept.withColumn("added_text", added), ["diff_id", "file_path", "added_text", "full_content"])
    text = F.coalesce("full_content", "added_text")
    language = T.provider_language(F.col("file_path"))
    one = F.struct(language.alias("language"), F.md5(text).alias("text_md5"), ((language != "unknown") & (F.size("added") > 0)).alias("reviewed"))
    some = F.regexp_replace("added_text", r"[\s\p{Z}]", "") != ""
    return rows_of(h, ["diff_id"], F.when(some, F.array(one)), "language")


def language_variants(spark: SparkSession, d: str) -> DataFrame:
    """The language of a path as reviewers and as the fix loop see it."""
    return table(spark, d, "diff_files").select("diff_id", T.reviewer_language(F.col("file_path")).alias("reviewer_language"), T.fixer_language(F.col("file_path")).alias("fixer_language"))


def lookup_texts(spark: SparkSession, d: str) -> DataFrame:
    """What is looked up for each document, by the kind of search; null for a text without any sign."""
    t = spread(table(spark, d, "documents").select("doc_id", "text", "lang"))
    some = F.when(F.regexp_replace("text", r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]", "") != "", F.col("text"))
    broad = F.substring(some, 1, LOOKED_UP["broad"])
    broad = F.when(F.coalesce("lang", F.lit("")) != "", F.concat(F.lit("["), F.col("lang"), F.lit("] "), broad)).otherwise(broad)
    return t.select("doc_id", F.md5(broad).alias("broad"), F.md5(F.substring(some, 1, LOOKED_UP["precise"])).alias("precise"), F.md5(F.substring(some, 1, LOOKED_UP["scan"])).alias("scan"))


def finding_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Every finding with its evidence, or without: reviewers with a domain of their own are looked up there, others in all."""
    v = table(spark, d, "embeddings")
    source: Column = F.get(F.array(*map(F.lit, SOURCES)), F.pmod(F.floor(F.col("vec_id") / 100), F.lit(len(SOURCES))).cast("int"))
    found = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), source.alias("source"), "embedding")
    domain = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in DOMAIN_OF_SOURCE.items() for x in kv)), "source"), F.lit(-1))
    asked = found.where(F.col("source") != OWN_EVIDENCE).select("id", domain.alias("domain"), "embedding")
    c = v.select(F.col("vec_id").alias("id"), F.explode(F.array(F.col("label").cast("int"), F.lit(-1))).alias("domain"), "embedding")
    c = c.where(F.col("domain").isin(-1, *DOMAIN_OF_SOURCE.values()))
    e = nearest(asked, c, 3, same_domain=True).where(F.col("score") >= EVIDENCE_RELEVANCE)
    e = e.select(F.col("query_id").alias("id"), "clause_id", "rank", F.round("score", 4).alias("relevance"))
    return found.select("id", "source").join(e, "id", "left").withColumnRenamed("id", "finding_id")


def plan_parse(spark: SparkSession, d: str) -> DataFrame:
    """Events written as raw plans of changes and read back: rows whose places are no numbers are left out, gaps take defaults."""
    k = F.get_json_object("props", "$.k").cast("int")
    row = lambda start: F.concat(F.lit('{"original_snippet": "a", "patched_snippet": "b", "start_line": '), start, F.lit("}"))
    rows = F.concat_ws(", ", row(k.cast("string")), row(F.concat(F.lit('"'), k.cast("string"), F.lit('"'))), row(F.lit('"x"')), row(F.lit("null")), F.lit('{"file_path": "z"}'))
    rest = F.when(k % 10 == 0, "").otherwise(F.concat(F.lit(', "affected_callers": ["f", "g"], "confidence": '), (k / 100).cast("string")))
    text = F.when(k % 7 == 0, F.lit("no plan today")).otherwise(F.concat(F.lit('Plan:\n```json\n{"patches": ['), rows, F.lit("]"), rest, F.lit("}\n```")))
    p = parse_plans(table(spark, d, "events").select("event_id", text.alias("text")), ["event_id"], "text", F.lit("here.py"))
    places = F.aggregate("patches", F.lit(0).cast("bigint"), lambda n, x: n + x["start_line"])
    return p.select("event_id", "parsed", F.size("patches").cast("bigint").alias("patches"), places.alias("places"), F.try_element_at("patches", F.lit(-1))["file_path"].alias("last_path"), F.size("affected_callers").cast("bigint").alias("callers"), "confidence")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """The latest delivery of each changed file as a file of its pull request's own snapshot (``git_ref`` is its number),
    with symbols, imports and numbers of added lines; all found in the row, so that no text is moved."""
    t = table(spark, d, "diff_files").where("repo is not null and pr is not null and file_path is not null")
    s = spread(t.select(F.col("diff_id").alias("src_id"), "repo", F.col("pr").cast("string").alias("git_ref"), F.col("file_path").alias("path"), "fetched_at", "patch", "full_content"))
    lang = T.index_language(F.col("path"))
    imports = F.when(lang.isNotNull() & (lang != "json") & F.col("full_content").isNotNull(), S.specifiers(F.col("full_content"), lang)).otherwise(F.array().cast("array<string>"))
    keep = ["src_id", *G.NS, "path", "fetched_at"]
    p = S.with_parsed(s.withColumn("specifiers", imports), [*keep, "patch", "specifiers"], "full_content", F.coalesce(lang, F.lit("")))
    p = D.with_added(p, [*keep, "specifiers", "symbols"])
    last = p.groupBy(*G.NS, "path").agg(F.max_by(F.struct("src_id", "symbols", "specifiers", "added"), F.struct("fetched_at", "src_id")).alias("v"))
    return last.select("v.src_id", *G.NS, "path", "v.symbols", "v.specifiers", "v.added")


def change_impact(spark: SparkSession, d: str) -> DataFrame:
    """Risk of each changed file inside its pull request: its changed symbols, their callers, the files that import it."""
    parsed = durable(_changes(spark, d))
    symbols = _symbols_of(parsed)
    edges = durable(G.caller_edges(symbols))
    touched = F.filter("symbols", lambda x: F.exists("added", lambda n: n.between(x["start_line"], x["end_line"])))
    files = parsed.select(*G.NS, "path", F.when(F.size("added") == 0, F.col("symbols")).otherwise(touched).alias("changed"))
    changed = files.select(*G.NS, "path", F.inline("changed")).withColumn("id", G.symbol_id(F.col("path"), F.col("qualified_name"), F.col("start_line")))
    c = G.callers_of_files(changed, edges).groupBy(*G.NS, "path").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") == 2).alias("second"))
    k = G.dependents(_dependencies_of(parsed), parsed.select(*G.NS, "path")).groupBy(*G.NS, "path").agg(F.count("*").alias("depend"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("changed", lambda x: x["name"]))), " ")
    f = files.select(*G.NS, "path", F.size("changed").alias("n_changed"), names.alias("names"))
    j = f.join(c, [*G.NS, "path"], "left").join(k, [*G.NS, "path"], "left").fillna(0, ["direct", "second", "depend"])
    score, level, _ = G.risk(F.col("n_changed"), F.col("direct"), F.col("second"), F.col("depend"), F.concat_ws(" ", "path", "names"))
    return j.select("repo", F.col("git_ref").cast("int").alias("pr"), "path", F.col("n_changed").cast("bigint").alias("n_changed"), "direct", "second", "depend", score.alias("risk_score"), level.alias("risk_level"))


def pull_request_risk(spark: SparkSession, d: str) -> DataFrame:
    """The greatest risk among the files of each pull request, with how many files have it."""
    i = change_impact(spark, d)
    rank = F.array_position(F.array(*map(F.lit, G.LEVELS)), F.col("risk_level")).cast("int")
    g = i.groupBy("repo", "pr").agg(F.count("*").alias("files"), F.max("risk_score").alias("risk_score"), F.max(rank).alias("r"), *(F.count_if(F.col("risk_level") == x).alias(x) for x in G.LEVELS))
    return g.select("repo", "pr", "files", "risk_score", F.element_at(F.array(*map(F.lit, G.LEVELS)), F.col("r")).alias("risk_level"), *G.LEVELS)


def chunk_impact(spark: SparkSession, d: str) -> DataFrame:
    """Each review chunk with the risk of its file or, where that is not known, of its whole pull request."""
    i = durable(change_impact(spark, d).select("repo", "pr", "path", "risk_score"))
    whole = i.groupBy("repo", "pr").agg(F.max("risk_score").alias("whole"))
    c = table(spark, d, "review_chunks").where("chunk_id is not null").groupBy("chunk_id", "repo", "pr").agg(F.max("file_path").alias("path"))
    j = c.join(i, ["repo", "pr", "path"], "left").join(whole, ["repo", "pr"], "left")
    return j.select("chunk_id", F.coalesce("risk_score", "whole").alias("risk_score"), F.col("risk_score").isNull().alias("of_whole"))


QUERIES = {f.__name__: f for f in (diff_split, review_files, language_variants, lookup_texts, finding_evidence, plan_parse, change_impact, pull_request_risk, chunk_impact)}

_SUFFIX = "CASE WHEN contains(file_path, '.') THEN lower(string_split(file_path, '.')[-1]) END"
_BLANK = "regexp_replace({}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]', '', 'g')"
_CHANGED = f"""files AS (SELECT diff_id AS src_id, repo, pr::VARCHAR AS git_ref, file_path AS path, full_content AS content FROM (SELECT *, row_number() OVER (PARTITION BY repo, pr, file_path ORDER BY fetched_at DESC NULLS LAST, diff_id DESC) AS rn
  FROM diff_files WHERE repo IS NOT NULL AND pr IS NOT NULL AND file_path IS NOT NULL) WHERE rn = 1)"""

def _added() -> str:
    """The CTEs of the added lines, from the query of that name."""
    return DIFF_SQL["added_lines_index"].partition("WITH ")[2].replace("SELECT DISTINCT diff_id, new_line FROM c WHERE add", "added AS (SELECT DISTINCT diff_id, new_line FROM c WHERE add)").rstrip().replace("FROM a)\n added", "FROM a),\n added")


_IMPACT = f"""WITH {_added()}, {_CHANGED}, {sql_parsed()},
calls AS (SELECT DISTINCT repo, git_ref, id AS caller_id, unnest(calls) AS name FROM sym),
edges AS (SELECT DISTINCT k.repo, k.git_ref, s.id AS callee_id, k.caller_id FROM calls k JOIN sym s ON s.repo = k.repo AND s.git_ref = k.git_ref AND s.name = k.name WHERE s.id <> k.caller_id),
{_DEPENDENTS},
chg AS (SELECT s.* FROM sym s WHERE s.src_id NOT IN (SELECT diff_id FROM added) OR EXISTS (SELECT 1 FROM added x WHERE x.diff_id = s.src_id AND x.new_line BETWEEN s.start_line AND s.end_line)),
d1 AS (SELECT DISTINCT s.repo, s.git_ref, s.path, e.caller_id FROM chg s JOIN edges e ON e.repo = s.repo AND e.git_ref = s.git_ref AND e.callee_id = s.id),
d2 AS (SELECT DISTINCT d1.repo, d1.git_ref, d1.path, e.caller_id FROM d1 JOIN edges e ON e.repo = d1.repo AND e.git_ref = d1.git_ref AND e.callee_id = d1.caller_id EXCEPT SELECT * FROM d1),
cnt AS (SELECT f.repo, f.git_ref, f.path, coalesce(n.c, 0) AS nc, coalesce(x.c, 0) AS na, coalesce(y.c, 0) AS nb, coalesce(k.c, 0) AS nk, concat_ws(' ', f.path, n.names) AS txt FROM files f
  LEFT JOIN (SELECT repo, git_ref, path, count(*) AS c, string_agg(DISTINCT name, ' ' ORDER BY name) AS names FROM chg GROUP BY 1, 2, 3) n USING (repo, git_ref, path)
  LEFT JOIN (SELECT repo, git_ref, path, count(*) AS c FROM d1 GROUP BY 1, 2, 3) x USING (repo, git_ref, path)
  LEFT JOIN (SELECT repo, git_ref, path, count(*) AS c FROM d2 GROUP BY 1, 2, 3) y USING (repo, git_ref, path)
  LEFT JOIN (SELECT repo, git_ref, path, count(*) AS c FROM dep GROUP BY 1, 2, 3) k USING (repo, git_ref, path)),
sc AS (SELECT *, least(100, 10 + CASE WHEN nc > 0 THEN least(25, 5 * nc) ELSE 15 END + least(30, 7 * na) + least(15, 3 * nb) + least(20, 4 * nk) + CASE WHEN len(list_filter({G.RISK_WORDS}, lambda w: contains(lower(txt), w))) > 0 THEN 20 ELSE 0 END)::BIGINT AS risk_score FROM cnt),
imp AS (SELECT repo, git_ref::INT AS pr, path, nc::BIGINT AS n_changed, na::BIGINT AS direct, nb::BIGINT AS second, nk::BIGINT AS depend, risk_score, CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 35 THEN 'medium' ELSE 'low' END AS risk_level FROM sc)"""

ORACLES = {
    "diff_split": "SELECT diff_id, 1::BIGINT AS file_no, file_path, md5(patch) AS patch_md5 FROM diff_files WHERE patch IS NOT NULL AND file_path IS NOT NULL UNION ALL SELECT diff_id, 2, 'copy/' || file_path, md5(patch) FROM diff_files WHERE patch IS NOT NULL AND file_path IS NOT NULL",
    "review_files": f"""WITH ad AS ({DIFF_SQL["added_text"]}), nr AS (SELECT DISTINCT diff_id FROM ({DIFF_SQL["added_lines_index"]}))
 SELECT f.diff_id, coalesce({sql_lookup(_SUFFIX, T.PROVIDER_LANGUAGES)}, 'unknown') AS language, md5(coalesce(full_content, added)) AS text_md5,
  coalesce({sql_lookup(_SUFFIX, T.PROVIDER_LANGUAGES)}, 'unknown') <> 'unknown' AND nr.diff_id IS NOT NULL AS reviewed
 FROM diff_files f JOIN ad ON ad.diff_id = f.diff_id LEFT JOIN nr ON nr.diff_id = f.diff_id
 WHERE coalesce(status, '') <> 'removed' AND {sql_first_match("file_path", T.PROVIDER_SKIPPED)} IS NULL AND regexp_replace(added, '[\\s\\p{{Z}}]', '', 'g') <> ''""",
    "language_variants": f"SELECT diff_id, coalesce({sql_lookup(_SUFFIX, T.REVIEWER_LANGUAGES)}, 'unknown') AS reviewer_language, coalesce({sql_lookup(_SUFFIX, T.FIXER_LANGUAGES)}, 'python') AS fixer_language FROM diff_files",
    "lookup_texts": f"""WITH t AS (SELECT doc_id, lang, CASE WHEN {_BLANK.format("text")} <> '' THEN text END AS s FROM documents)
 SELECT doc_id, md5(CASE WHEN coalesce(lang, '') <> '' THEN '[' || lang || '] ' || s[1:{LOOKED_UP["broad"]}] ELSE s[1:{LOOKED_UP["broad"]}] END) AS broad, md5(s[1:{LOOKED_UP["precise"]}]) AS precise, md5(s[1:{LOOKED_UP["scan"]}]) AS scan FROM t""",
    "finding_evidence": f"""WITH q AS (SELECT vec_id, embedding, {SOURCES}[(vec_id // 100) % {len(SOURCES)} + 1] AS source FROM embeddings WHERE vec_id % 100 = 0),
 n0 AS (SELECT q.vec_id AS finding_id, c.vec_id AS clause_id, greatest(round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6), 0) AS score FROM q JOIN embeddings c
   ON q.vec_id <> c.vec_id AND q.source <> '{OWN_EVIDENCE}' AND CASE q.source {" ".join(f"WHEN '{k}' THEN c.label = {v}" for k, v in DOMAIN_OF_SOURCE.items())} ELSE true END),
 n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY score DESC, clause_id) AS rank FROM n0) WHERE rank <= 3 AND score >= {EVIDENCE_RELEVANCE})
 SELECT q.vec_id AS finding_id, source, clause_id, rank, round(score, 4) AS relevance FROM q LEFT JOIN n ON n.finding_id = q.vec_id""",
    "plan_parse": """WITH e AS (SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events)
 SELECT event_id, k % 7 <> 0 AS parsed, CASE WHEN k % 7 = 0 THEN 0 ELSE 3 END::BIGINT AS patches, CASE WHEN k % 7 = 0 THEN 0 ELSE 2 * k END::BIGINT AS places, CASE WHEN k % 7 <> 0 THEN 'z' END AS last_path,
  CASE WHEN k % 7 = 0 OR k % 10 = 0 THEN 0 ELSE 2 END::BIGINT AS callers, CASE WHEN k % 7 = 0 OR k % 10 = 0 THEN 0.8 ELSE k / 100 END::DOUBLE AS confidence FROM e""",
    "change_impact": f"{_IMPACT} SELECT * FROM imp",
    "pull_request_risk": f"""{_IMPACT} SELECT repo, pr, count(*) AS files, max(risk_score) AS risk_score, {G.LEVELS}[max(list_position({G.LEVELS}, risk_level))] AS risk_level, {", ".join(f"count(*) FILTER (risk_level = '{x}') AS {x}" for x in G.LEVELS)} FROM imp GROUP BY 1, 2""",
    "chunk_impact": f"""{_IMPACT}, ch AS (SELECT chunk_id, repo, pr, max(file_path) AS path FROM review_chunks WHERE chunk_id IS NOT NULL GROUP BY 1, 2, 3), w AS (SELECT repo, pr, max(risk_score) AS whole FROM imp GROUP BY 1, 2)
 SELECT chunk_id, coalesce(risk_score, whole) AS risk_score, risk_score IS NULL AS of_whole FROM ch LEFT JOIN imp USING (repo, pr, path) LEFT JOIN w USING (repo, pr)""",
}
