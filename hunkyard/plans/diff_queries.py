"""Queries on changed files: hunks, numbered lines, reasons for skipping, token costs, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkyard.functions import text as T
from hunkyard.operators import diff as D
from hunkyard.session import durable, spread
from hunkyard.sources.tables import table


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "diff_files")


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.tokens(F.col("text")).cast("bigint").alias("tokens"))


def language_detect(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("diff_id", T.provider_language(F.col("file_path")).alias("provider_language"), T.index_language(F.col("file_path")).alias("index_language"))


def skip_cascade(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("file_path")
    return _files(spark, d).select("diff_id", D.skip_reason(p, F.col("status"), F.col("patch")).alias("reason"), T.first_match(p, T.PROVIDER_SKIPPED).isNotNull().alias("skipped_by_provider"))


def hunk_parse(spark: SparkSession, d: str) -> DataFrame:
    return D.hunks(spread(_files(spark, d).select("diff_id", "patch")))


def diff_line_numbers(spark: SparkSession, d: str) -> DataFrame:
    return D.numbered_lines(_files(spark, d)).select("diff_id", "hunk_no", F.col("pos").cast("bigint").alias("pos"), "kind", "old_line", "new_line")


def added_lines_index(spark: SparkSession, d: str) -> DataFrame:
    return D.added_line_numbers(spread(_files(spark, d).select("diff_id", "patch")))


def added_text(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("diff_id", T.added_text(F.col("patch")).alias("added"))


def hunk_context(spark: SparkSession, d: str) -> DataFrame:
    return D.hunk_context(spread(_files(spark, d).select("diff_id", "patch", "full_content")))


def file_tokens(spark: SparkSession, d: str) -> DataFrame:
    return D.file_tokens(spread(_files(spark, d).select("diff_id", "file_path", "language", "status", "patch", "full_content")))


# The budget of a review where a repository has none of its own.
DEFAULT_TOKENS, DEFAULT_CHUNKS = 6000, 24


def _budgeted(spark: SparkSession, d: str) -> DataFrame:
    """Every changed file with the budget of its repository, or the usual one."""
    b = table(spark, d, "chunk_budgets").groupBy("repo").agg(F.min("max_tokens").alias("max_tokens"), F.min("max_chunks").alias("max_chunks"))
    j = spread(_files(spark, d)).join(b, "repo", "left")
    return j.withColumn("max_tokens", F.coalesce("max_tokens", F.lit(DEFAULT_TOKENS))).withColumn("max_chunks", F.coalesce("max_chunks", F.lit(DEFAULT_CHUNKS)))


def _latest(files: DataFrame) -> DataFrame:
    """``repo, pr, ord, diff_id, file_path, skipped`` of the latest delivery of each file; a row without ord is a file of its own.

    Whether it is skipped is found in the row, so that no text is moved.
    """
    key = F.coalesce(F.col("ord").cast("string"), F.concat(F.lit("id "), F.col("diff_id").cast("string")))
    reason = D.skip_reason(F.col("file_path"), F.col("status"), F.col("patch"))
    g = files.select("repo", "pr", "ord", key.alias("k"), "fetched_at", "diff_id", "file_path", reason.isNotNull().alias("skipped")).groupBy("repo", "pr", "k")
    last = g.agg(F.max_by(F.struct("ord", "diff_id", "file_path", "skipped"), F.struct("fetched_at", "diff_id")).alias("v"))
    return last.select("repo", "pr", "v.ord", "v.diff_id", "v.file_path", "v.skipped")


def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    c = D.chunks(_budgeted(spark, d))
    return c.select("diff_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "token_count", "compressed")


def _per_file(spark: SparkSession, d: str) -> DataFrame:
    """Files of the latest delivery that are reviewed, with their chunks; the chunks are counted in the file's own row."""
    f = _budgeted(spark, d)
    n = D.chunk_counts(f, ["diff_id", "max_chunks"]).withColumn("max_chunks", F.col("max_chunks").cast("bigint"))
    return durable(n.join(_latest(_files(spark, d)), "diff_id"))  # narrow, and read twice by the running sums


def chunk_cap(spark: SparkSession, d: str) -> DataFrame:
    """Slots are taken in the order of the files in their pull request; files without a place come last, by id."""
    f = _per_file(spark, d).withColumn("place", F.coalesce(F.col("ord").cast("bigint"), F.lit(1 << 40) + F.col("diff_id")))
    # a filter on the chunks before the windows would be pushed to the scan and fold every file twice
    return D.cap_chunks(f, ["repo", "pr"], "place").where("n_chunks > 0").select("repo", "pr", "ord", "diff_id", "n_chunks", "kept_chunks", "omitted")


def omitted_files(spark: SparkSession, d: str) -> DataFrame:
    """The files of each pull request that the slots do not suffice for, wholly or in part, and how many chunks are lost."""
    f = chunk_cap(spark, d).where("omitted").join(_latest(_files(spark, d)).select("diff_id", "file_path"), "diff_id")
    return f.select("repo", "pr", "ord", "file_path", (F.col("n_chunks") - F.col("kept_chunks")).alias("lost_chunks"))


def pipeline_summary(spark: SparkSession, d: str) -> DataFrame:
    """Files, skipped files, chunks and tokens of each pull request."""
    f = _latest(spread(_files(spark, d)))
    c = D.chunk_counts(_budgeted(spark, d), ["diff_id"])
    g = f.join(c, "diff_id", "left").groupBy("repo", "pr")
    return g.agg(F.count("*").alias("files"), F.count_if("skipped").alias("skipped_files"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


QUERIES = {
    f.__name__: f
    for f in (token_estimate, language_detect, skip_cascade, hunk_parse, diff_line_numbers, added_lines_index, added_text, hunk_context, file_tokens, chunk_pack, chunk_cap, omitted_files, pipeline_summary)
}


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_tokens(e: str) -> str:
    return f"coalesce(len(regexp_extract_all({e}, {sql_text(T.TOKEN)})), 0)"


def sql_lines(e: str) -> str:
    """A list of lines: the split text without its last part where that is empty."""
    s = f"string_split_regex(coalesce({e}, ''), {sql_text(T.LINE_END)})"
    return f"(CASE WHEN regexp_matches(coalesce({e}, ''), '(?:{T.LINE_END})\\z') OR coalesce({e}, '') = '' THEN {s}[1:len({s}) - 1] ELSE {s} END)"


def sql_first_match(e: str, patterns: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({e}, {sql_text(p)}) THEN {sql_text(p)}" for p in patterns) + " END"


def sql_lookup(e: str, names: dict[str, str]) -> str:
    return f"CASE {e} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


_H = sql_text(D.HUNK)
_SUFFIX = "CASE WHEN contains(file_path, '.') THEN lower(string_split(file_path, '.')[-1]) END"
_PL = f"""
raw AS (SELECT diff_id, {sql_lines("patch")} AS s FROM diff_files),
pl0 AS (SELECT diff_id, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS pos FROM raw),
pl1 AS (SELECT *, regexp_matches(line, {_H}) AS head FROM pl0),
pl AS (SELECT * FROM (SELECT *, sum(head::INT) OVER (PARTITION BY diff_id ORDER BY pos)::INT AS hunk_no FROM pl1) WHERE hunk_no > 0),
num0 AS (SELECT *, CASE WHEN head THEN '@' WHEN line[1:1] = '\\' THEN '\\' WHEN line[1:1] IN ('+', '-') THEN line[1:1] ELSE ' ' END AS kind FROM pl),
num1 AS (SELECT *,
  max(CASE WHEN head THEN regexp_extract(line, {_H}, 1)::BIGINT END) OVER (PARTITION BY diff_id, hunk_no) + coalesce(sum((kind IN ('-', ' '))::INT) OVER w, 0)::BIGINT AS o,
  max(CASE WHEN head THEN regexp_extract(line, {_H}, 3)::BIGINT END) OVER (PARTITION BY diff_id, hunk_no) + coalesce(sum((kind IN ('+', ' '))::INT) OVER w, 0)::BIGINT AS n
  FROM num0 WINDOW w AS (PARTITION BY diff_id, hunk_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
num AS (SELECT diff_id, hunk_no, pos, kind, CASE WHEN kind IN ('-', ' ') THEN o END AS old_line, CASE WHEN kind IN ('+', ' ') THEN n END AS new_line, line FROM num1)"""
_REASON = f"""CASE WHEN {sql_first_match("file_path", T.IGNORED_PATHS)} IS NOT NULL THEN 'ignored by pattern: ' || {sql_first_match("file_path", T.IGNORED_PATHS)}
 WHEN status = 'removed' THEN 'removed file'
 WHEN coalesce(regexp_replace(patch, '[\\s\\p{{Z}}]', '', 'g'), '') = '' THEN 'empty patch'
 WHEN hs.diff_id IS NULL THEN 'no parseable hunks'
 WHEN NOT hs.adds THEN 'no added or modified lines' END"""
_KEPT = f"""{_PL},
hs AS (SELECT diff_id, bool_or(line[1:1] = '+') AS adds FROM pl GROUP BY 1),
reasons AS (SELECT f.diff_id, {_REASON} AS reason FROM diff_files f LEFT JOIN hs ON hs.diff_id = f.diff_id),
kept AS (SELECT f.*, {D.FRAME_TOKENS} + {sql_tokens("file_path")} + {sql_tokens("coalesce(language, 'unknown')")} + {sql_tokens("status")} AS frame
         FROM diff_files f JOIN reasons r ON r.diff_id = f.diff_id AND r.reason IS NULL)"""
_CTX = f"""fl AS (SELECT diff_id, {sql_lines("full_content")} AS s FROM diff_files),
span AS (SELECT diff_id, hunk_no, min(new_line) AS lo, max(new_line) AS hi FROM num WHERE kind = '+' GROUP BY 1, 2),
ctx AS (SELECT span.diff_id, hunk_no, greatest(lo - {D.CONTEXT_LINES}, 1) AS first_line, least(hi + {D.CONTEXT_LINES}, len(s)) AS last_line FROM span JOIN fl ON fl.diff_id = span.diff_id WHERE len(s) > 0)"""
_COST = f"""{_CTX},
ft AS (SELECT diff_id, generate_subscripts(s, 1) AS ln, unnest(s) AS t FROM fl),
cost AS (
  SELECT diff_id, hunk_no, 1 AS part, pos::DOUBLE AS pos, CASE WHEN kind IN ('@', '\\') THEN {sql_tokens("line")} ELSE 2 + {sql_tokens("CASE WHEN line[1:1] IN (' ', '+', '-') THEN line[2:] ELSE line END")} END AS cost FROM num SEMI JOIN kept USING (diff_id)
  UNION ALL SELECT diff_id, hunk_no, 1, pos + 0.5, {D.COLUMNS_LINE} FROM num SEMI JOIN kept USING (diff_id) WHERE kind = '@'
  UNION ALL SELECT diff_id, hunk_no, 2, 0, {D.CONTEXT_HEADING} FROM ctx SEMI JOIN kept USING (diff_id) WHERE first_line <= last_line
  UNION ALL SELECT ctx.diff_id, hunk_no, 2, ln, 2 + {sql_tokens("t")} FROM ctx JOIN ft ON ft.diff_id = ctx.diff_id AND ln BETWEEN first_line AND last_line SEMI JOIN kept ON kept.diff_id = ctx.diff_id)"""
_PACKED = f"""WITH RECURSIVE {_KEPT}, {_COST},
b AS (SELECT repo, min(max_tokens) AS max_tokens, min(max_chunks) AS max_chunks FROM chunk_budgets GROUP BY 1),
fb AS (SELECT k.diff_id, k.repo, k.pr, frame, greatest(coalesce(max_tokens, {DEFAULT_TOKENS}), {D.LEAST_BUDGET}) AS budget, coalesce(max_chunks, {DEFAULT_CHUNKS}) AS max_chunks FROM kept k LEFT JOIN b ON b.repo = k.repo),
hc AS (SELECT c.diff_id, hunk_no, sum(cost) AS hcost, any_value(frame) + sum(cost) > any_value(budget) AS big FROM cost c JOIN fb ON fb.diff_id = c.diff_id GROUP BY 1, 2),
items AS (SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY hunk_no, part, pos) AS rn FROM (
  SELECT diff_id, hunk_no, 0 AS part, 0.0::DOUBLE AS pos, hcost AS cost, false AS split FROM hc WHERE NOT big
  UNION ALL SELECT c.diff_id, c.hunk_no, part, pos, cost, true FROM cost c JOIN hc ON hc.diff_id = c.diff_id AND hc.hunk_no = c.hunk_no AND big)),
fold AS (
  SELECT i.diff_id, rn, 1 AS chunk_no, frame + cost AS t, split, hunk_no FROM items i JOIN fb ON fb.diff_id = i.diff_id WHERE rn = 1
  UNION ALL
  SELECT i.diff_id, i.rn, f.chunk_no + brk, CASE WHEN brk = 1 THEN frame + i.cost ELSE f.t + i.cost END, i.split, i.hunk_no
  FROM fold f JOIN items i ON i.diff_id = f.diff_id AND i.rn = f.rn + 1 JOIN fb ON fb.diff_id = i.diff_id,
  LATERAL (SELECT (f.t + i.cost > budget OR f.split <> i.split OR (i.split AND f.hunk_no <> i.hunk_no))::INT AS brk)),
packed AS (SELECT diff_id, chunk_no::BIGINT AS chunk_no, max(t)::BIGINT AS token_count, any_value(split) AS compressed FROM fold GROUP BY 1, 2),
last AS (SELECT diff_id, repo, pr, ord, file_path FROM (SELECT *, row_number() OVER (PARTITION BY repo, pr, coalesce(ord::VARCHAR, 'id ' || diff_id) ORDER BY fetched_at DESC NULLS LAST, diff_id DESC) AS rn FROM diff_files) WHERE rn = 1),
per AS (SELECT p.diff_id, any_value(last.repo) AS repo, any_value(last.pr) AS pr, any_value(last.ord) AS ord, any_value(file_path) AS file_path, count(*) AS n_chunks, any_value(max_chunks) AS max_chunks, sum(token_count) AS tokens
  FROM packed p JOIN fb ON fb.diff_id = p.diff_id JOIN last ON last.diff_id = p.diff_id GROUP BY 1)"""
_CAPPED = """r AS (SELECT *, coalesce(sum(n_chunks) OVER (PARTITION BY repo, pr ORDER BY ord NULLS LAST, diff_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM per),
capped AS (SELECT repo, pr, ord, file_path, diff_id, n_chunks, greatest(least(n_chunks, max_chunks - before), 0)::BIGINT AS kept_chunks, max_chunks - before < n_chunks AS omitted FROM r)"""

ORACLES = {
    "token_estimate": f"SELECT doc_id, {sql_tokens('text')}::BIGINT AS tokens FROM documents",
    "language_detect": f"""SELECT diff_id, coalesce({sql_lookup(_SUFFIX, T.PROVIDER_LANGUAGES)}, 'unknown') AS provider_language,
 CASE WHEN NOT list_has_any(string_split(file_path, '/'), {T.INDEX_SKIPPED_PARTS}) AND regexp_matches(string_split(file_path, '/')[-1], '[^.]\\.') THEN {sql_lookup(_SUFFIX, T.INDEX_LANGUAGES)} END AS index_language FROM diff_files""",
    "skip_cascade": f"WITH {_KEPT} SELECT f.diff_id, reason, {sql_first_match('file_path', T.PROVIDER_SKIPPED)} IS NOT NULL AS skipped_by_provider FROM diff_files f JOIN reasons r ON r.diff_id = f.diff_id",
    "hunk_parse": f"""WITH {_PL} SELECT diff_id, hunk_no, max(CASE WHEN head THEN regexp_extract(line, {_H}, 1)::BIGINT END) AS old_start,
 max(CASE WHEN head THEN coalesce(nullif(regexp_extract(line, {_H}, 2), ''), '1')::BIGINT END) AS old_count, max(CASE WHEN head THEN regexp_extract(line, {_H}, 3)::BIGINT END) AS new_start,
 max(CASE WHEN head THEN coalesce(nullif(regexp_extract(line, {_H}, 4), ''), '1')::BIGINT END) AS new_count, count(*) FILTER (NOT head) AS n_lines,
 count(*) FILTER (NOT head AND line[1:1] = '+') AS n_added, count(*) FILTER (NOT head AND line[1:1] = '-') AS n_removed FROM pl GROUP BY 1, 2""",
    "diff_line_numbers": f"WITH {_PL} SELECT diff_id, hunk_no, pos::BIGINT AS pos, kind, old_line, new_line FROM num",
    "added_lines_index": f"""WITH {_PL}, a AS (SELECT *, starts_with(line, '+') AND NOT starts_with(line, '+++') AND NOT head AS add,
  CASE WHEN head OR (starts_with(line, '-') AND NOT starts_with(line, '---')) THEN 0 ELSE 1 END AS step FROM pl),
 c AS (SELECT *, max(CASE WHEN head THEN regexp_extract(line, {_H}, 3)::BIGINT END) OVER (PARTITION BY diff_id, hunk_no)
  + coalesce(sum(step) OVER (PARTITION BY diff_id, hunk_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS new_line FROM a)
 SELECT DISTINCT diff_id, new_line FROM c WHERE add""",
    "added_text": f"SELECT diff_id, coalesce(array_to_string(list_transform(list_filter({sql_lines('patch')}, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')), lambda x: x[2:]), chr(10)), '') AS added FROM diff_files",
    "hunk_context": f"WITH {_PL}, {_CTX} SELECT diff_id, hunk_no, first_line, last_line FROM ctx",
    "file_tokens": f"""WITH {_KEPT}, {_COST}, t AS (SELECT diff_id, sum(cost) AS c FROM cost GROUP BY 1)
 SELECT f.diff_id, coalesce(frame + c, 0)::BIGINT AS tokens FROM diff_files f LEFT JOIN kept k ON k.diff_id = f.diff_id LEFT JOIN t ON t.diff_id = k.diff_id""",
    "chunk_pack": f"{_PACKED} SELECT * FROM packed",
    "chunk_cap": f"{_PACKED}, {_CAPPED} SELECT repo, pr, ord, diff_id, n_chunks, kept_chunks, omitted FROM capped",
    "omitted_files": f"{_PACKED}, {_CAPPED} SELECT repo, pr, ord, file_path, n_chunks - kept_chunks AS lost_chunks FROM capped WHERE omitted",
    "pipeline_summary": f"""{_PACKED} SELECT f.repo, f.pr, count(*) AS files, count(*) FILTER (reason IS NOT NULL) AS skipped_files, coalesce(sum(n_chunks), 0)::BIGINT AS chunks, coalesce(sum(tokens), 0)::BIGINT AS tokens
 FROM last f JOIN reasons r ON r.diff_id = f.diff_id LEFT JOIN per ON per.diff_id = f.diff_id GROUP BY 1, 2""",
}
