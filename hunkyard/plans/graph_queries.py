"""Queries on snapshots of repositories: symbols, callers, imports, context, risk."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkyard.functions import text as T
from hunkyard.functions.arrays import rows_of
from hunkyard.operators import diff as D
from hunkyard.operators import graph as G
from hunkyard.operators import symbols as S
from hunkyard.plans.diff_queries import _PL, sql_lines, sql_text
from hunkyard.session import durable, spread
from hunkyard.sources.files import snapshot
from hunkyard.sources.tables import table


def _latest(spark: SparkSession, d: str, *cols: Column) -> DataFrame:
    """``src_id, repo, git_ref, path`` of the latest delivery of each file, with ``cols`` of its content.

    What is needed of the content is computed in the row before the latest is chosen, so that no content is shuffled.
    """
    s = table(spark, d, "source_files")
    pick = F.max_by(F.struct("src_id", *cols), F.struct("fetched_at", "src_id")).alias("v")
    return s.groupBy("repo", "git_ref", "path").agg(pick).select("v.src_id", "repo", "git_ref", "path", *(f"v.{s.select(c).columns[0]}" for c in cols))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d)


def _contents(spark: SparkSession, d: str, where: str) -> DataFrame:
    """The latest deliveries with their content; only the ids of superseded ones are moved."""
    s = table(spark, d, "source_files").where(where).select("src_id", "repo", "git_ref", "path", "content")
    return s.join(_files(spark, d).where(where).select("src_id"), "src_id", "left_semi")


def _parsed(spark: SparkSession, d: str, with_bindings: bool = False) -> DataFrame:
    """The latest files with ``symbols``, ``specifiers`` and, if asked for, ``bindings``: one scan, one exchange of what was found."""
    s = spread(table(spark, d, "source_files").select("src_id", *G.NS, "path", "fetched_at", "content"))
    lang = T.index_language(F.col("path"))
    imports = F.when(lang.isNotNull() & (lang != "json") & F.col("content").isNotNull(), S.specifiers(F.col("content"), lang)).otherwise(F.array().cast("array<string>"))
    bindings = F.when(lang.isin("javascript", "typescript") & F.col("content").isNotNull(), S.script_bindings(F.col("content"))).otherwise(F.array().cast("array<struct<local_name:string,imported_name:string,specifier:string>>"))
    found = ["specifiers", "bindings"] if with_bindings else ["specifiers"]
    s = s.withColumn("specifiers", imports)
    s = s.withColumn("bindings", bindings) if with_bindings else s
    p = S.with_parsed(s, ["src_id", *G.NS, "path", "fetched_at", *found], "content", F.coalesce(lang, F.lit("")))
    last = p.groupBy(*G.NS, "path").agg(F.max_by(F.struct("src_id", "symbols", *found), F.struct("fetched_at", "src_id")).alias("v"))
    return last.select("v.src_id", *G.NS, "path", "v.symbols", *(f"v.{x}" for x in found))


def _symbols_of(parsed: DataFrame) -> DataFrame:
    s = parsed.select("src_id", *G.NS, "path", F.inline("symbols"))
    return s.withColumn("id", G.symbol_id(F.col("path"), F.col("qualified_name"), F.col("start_line")))


def _dependencies_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("src_id", *G.NS, "path", F.explode("specifiers").alias("specifier")).withColumn("dependency", S.normal_dependency(F.col("specifier")))


def _configs(spark: SparkSession, d: str) -> DataFrame:
    """The module configurations of all snapshots, a few rows written once."""
    return durable(G.module_configs(_contents(spark, d, "path like '%config.json'")))


class Snapshot:
    """Files, symbols, edges and dependents of all snapshots; what several steps read is written once."""

    def __init__(self, spark: SparkSession, d: str, with_bindings: bool = False):
        self.parsed = durable(_parsed(spark, d, with_bindings))
        self.files = self.parsed.select("src_id", *G.NS, "path")
        self.symbols = _symbols_of(self.parsed)
        self.dependencies = _dependencies_of(self.parsed)

    @cached_property
    def edges(self) -> DataFrame:
        return durable(G.caller_edges(self.symbols))

    @cached_property
    def dependents(self) -> DataFrame:
        return G.dependents(self.dependencies, self.files)


def text_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols by the forms of lines alone, whatever the language."""
    t = spread(table(spark, d, "source_files").select("src_id", *G.NS, "path", "fetched_at", "content"))
    p = S.with_symbols(t, ["src_id", *G.NS, "path", "fetched_at"], "content")
    last = p.groupBy(*G.NS, "path").agg(F.max_by(F.struct("src_id", "symbols"), F.struct("fetched_at", "src_id")).alias("v"))
    s = last.select(*G.NS, "path", F.inline("v.symbols")).withColumn("id", G.symbol_id(F.col("path"), F.col("name"), F.col("start_line")))
    return s.select("id", "repo", "git_ref", F.col("end_line").cast("bigint").alias("end_line"), F.size("calls").cast("bigint").alias("n_calls"))


def parsed_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols as the graph has them: of Python by its blocks, of other files by the forms of lines."""
    return _symbols_of(_parsed(spark, d)).select("id", "repo", "git_ref", "name", F.col("end_line").cast("bigint").alias("end_line"), F.array_join("calls", " ").alias("calls"))


def text_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return _dependencies_of(_parsed(spark, d)).select("src_id", "specifier", "dependency")


def python_symbols(spark: SparkSession, d: str) -> DataFrame:
    f = _contents(spark, d, "path like '%.py'")
    return S.python_symbols(f, "src_id", "content").withColumnRenamed("row_id", "src_id")


def python_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Definitions of the latest Python files by indentation, with qualified names and calls."""
    s = spread(table(spark, d, "source_files").where("path like '%.py'").select("src_id", *G.NS, "path", "fetched_at", "content"))
    b = S.with_blocks(s, ["src_id", *G.NS, "path", "fetched_at"], "content")
    last = b.groupBy(*G.NS, "path").agg(F.max_by(F.struct("src_id", "blocks"), F.struct("fetched_at", "src_id")).alias("v")).select("v.src_id", F.inline("v.blocks"))
    return last.select("src_id", "qualified_name", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), F.array_join("calls", " ").alias("calls"))


def python_imports(spark: SparkSession, d: str) -> DataFrame:
    f = _contents(spark, d, "path like '%.py'")
    return S.python_imports(f, "src_id", "content").withColumnRenamed("row_id", "src_id").distinct()


def caller_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.caller_edges(Snapshot(spark, d).symbols)


def callers_depth2(spark: SparkSession, d: str) -> DataFrame:
    return G.callers_within_two(Snapshot(spark, d).edges)


def import_resolve(spark: SparkSession, d: str) -> DataFrame:
    g = Snapshot(spark, d)
    return G.resolve_imports(g.dependencies, g.files, _configs(spark, d))


def script_imports(spark: SparkSession, d: str) -> DataFrame:
    """The names that imports of JavaScript and TypeScript files bind."""
    return _parsed(spark, d, with_bindings=True).select(*G.NS, "path", F.inline("bindings"))


def import_callers(spark: SparkSession, d: str) -> DataFrame:
    """Calls of names that imports of scripts bind, to the symbols of the files these imports mean."""
    g = Snapshot(spark, d, with_bindings=True)
    bindings = g.parsed.select(*G.NS, "path", F.inline("bindings"))
    asked = g.dependencies.join(bindings.select(*G.NS, "path", "specifier").distinct(), [*G.NS, "path", "specifier"], "left_semi")
    resolved = G.resolve_imports(asked, g.files, _configs(spark, d))
    return G.imported_callers(g.symbols, bindings, G.targets_or_importers(resolved, asked, g.dependencies))


def dependents(spark: SparkSession, d: str) -> DataFrame:
    return Snapshot(spark, d).dependents


def changed_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of a changed file whose lines an added line falls into; without added lines, all of them."""
    f = spread(table(spark, d, "diff_files").select("diff_id", "patch", "full_content"))
    s = S.with_symbols(f, ["diff_id", "patch"], "full_content")
    h = D.with_added(s, ["diff_id", "symbols"])
    touched = F.filter("symbols", lambda x: F.exists("added", lambda n: n.between(x["start_line"], x["end_line"])))
    e = rows_of(h, ["diff_id"], F.when(F.size("added") == 0, F.col("symbols")).otherwise(touched), "name")
    return e.select("diff_id", "name", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))


def context_topk(spark: SparkSession, d: str) -> DataFrame:
    g = Snapshot(spark, d)
    return G.related_symbols(g.symbols, g.edges, g.dependents).withColumn("score", F.col("score").cast("bigint"))


def impact_risk(spark: SparkSession, d: str) -> DataFrame:
    """Risk of changing each file as a whole."""
    g = Snapshot(spark, d)
    c = G.callers_of_files(g.symbols, g.edges).groupBy(*G.NS, "path").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") == 2).alias("second"))
    k = g.dependents.groupBy(*G.NS, "path").agg(F.count("*").alias("depend"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("symbols", lambda x: x["name"]))), " ")
    f = g.parsed.select(*G.NS, "path", F.size("symbols").alias("changed"), names.alias("names"))
    j = f.join(c, [*G.NS, "path"], "left").join(k, [*G.NS, "path"], "left").fillna(0, ["direct", "second", "depend"])
    score, level, reasons = G.risk(F.col("changed"), F.col("direct"), F.col("second"), F.col("depend"), F.concat_ws(" ", "path", "names"))
    return j.select(*G.NS, "path", score.alias("risk_score"), level.alias("risk_level"), reasons.alias("reasons"))


def repo_map(spark: SparkSession, d: str) -> DataFrame:
    f = _contents(spark, d, "path like '%.py'")
    return G.repo_map(S.python_functions(f, "src_id", "content").withColumnRenamed("row_id", "src_id").join(_files(spark, d), "src_id"))


def test_targets(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d).select(*G.NS, "path")
    is_test = F.rlike("path", F.lit(r"(?:^|/)test_[^/]*$"))
    return G.test_targets(f.where(~is_test), f.where(is_test))


def snapshot_cap(spark: SparkSession, d: str) -> DataFrame:
    """The files of each snapshot that the index takes in, the first five hundred by path."""
    return snapshot(_latest(spark, d, F.col("size_bytes")), G.NS, F.coalesce("size_bytes", F.lit(0))).select(*G.NS, "path", "src_id")


QUERIES = {f.__name__: f for f in (text_symbols, parsed_symbols, text_dependencies, python_symbols, python_blocks, python_imports, caller_edges, callers_depth2, import_resolve, script_imports, import_callers, dependents, changed_symbols, context_topk, impact_risk, repo_map, test_targets, snapshot_cap)}

_NAME = "CASE " + " ".join(f"WHEN regexp_matches(line, {sql_text(p)}) THEN regexp_extract(line, {sql_text(p)}, 1)" for p in S.DEFINITIONS) + " END"


def _sql_symbols(source: str, key: str, content: str, prefix: str) -> str:
    return f"""{prefix}r AS (SELECT {key}, {sql_lines(content)} AS s FROM {source}),
{prefix}l AS (SELECT {key}, unnest(s) AS line, generate_subscripts(s, 1) AS pos FROM {prefix}r),
{prefix}n AS (SELECT *, {_NAME} AS name FROM {prefix}l),
{prefix}d AS (SELECT *, count(name) OVER (PARTITION BY {key} ORDER BY pos) AS def_no FROM {prefix}n),
{prefix}b AS (SELECT {key}, min(pos) AS start_line, max(pos) AS end_line, max(name) AS name, string_agg(line, chr(10) ORDER BY pos) AS body FROM {prefix}d WHERE def_no > 0 GROUP BY {key}, def_no),
{prefix}sym AS (SELECT *, list_filter(list_distinct(regexp_extract_all(body, {sql_text(S.CALL)}, 1)), lambda x: x <> name) AS calls FROM {prefix}b)"""


_EXT = "regexp_matches(path, '[.](py|js|jsx|ts|tsx)$') AND NOT list_has_any(string_split(path, '/'), " + str(T.INDEX_SKIPPED_PARTS) + ") AND regexp_matches(string_split(path, '/')[-1], '[^.]\\.')"
_PYTHON = _EXT.replace("py|js|jsx|ts|tsx", "py")
_FILES = """files AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, git_ref, path ORDER BY fetched_at DESC NULLS LAST, src_id DESC) AS rn FROM source_files) WHERE rn = 1)"""
_BLOCKS = f"""m1 AS (SELECT src_id, array_to_string(list_transform(string_split(coalesce(content, ''), '\"\"\"'), lambda x, i: CASE WHEN i % 2 = 0 THEN regexp_replace(x, '[^\n]', '', 'g') ELSE x END), '\"\"\"') AS c FROM files WHERE path LIKE '%.py'),
m2 AS (SELECT src_id, array_to_string(list_transform(string_split(c, {sql_text("'''")}), lambda x, i: CASE WHEN i % 2 = 0 THEN regexp_replace(x, '[^\n]', '', 'g') ELSE x END), {sql_text("'''")}) AS c FROM m1),
ls AS (SELECT src_id, {sql_lines("c")} AS s FROM m2),
ln AS (SELECT src_id, unnest(s) AS x, generate_subscripts(s, 1) AS pos FROM ls),
rw AS (SELECT src_id, pos, length(regexp_extract(x, '^([ \t]*)', 1)) AS indent, regexp_matches(x, {sql_text(S.CLOSES)}) AS closes, nullif(regexp_extract(x, {sql_text(S.BLOCK)}, 1), '') AS name, regexp_matches(x, '^[ \t]*@') AS decorates FROM ln WHERE regexp_matches(x, '^[ \t]*[^\\s#]')),
df AS (SELECT d.src_id, d.pos, d.indent, d.name, coalesce((SELECT min(r.pos) FROM rw r WHERE r.src_id = d.src_id AND r.pos > d.pos AND r.indent <= d.indent AND NOT r.closes), (SELECT len(s) + 1 FROM ls WHERE ls.src_id = d.src_id)) AS stop,
  d.indent = 0 OR coalesce((SELECT max_by(r.name IS NOT NULL, r.pos) FROM rw r WHERE r.src_id = d.src_id AND r.pos < d.pos AND r.indent < d.indent AND NOT r.closes), false) AS inside FROM rw d WHERE d.name IS NOT NULL),
dl AS (SELECT df.*, (SELECT max(r.pos) FROM rw r WHERE r.src_id = df.src_id AND r.pos < df.stop) AS last,
  coalesce((SELECT max(r.pos) FROM rw r WHERE r.src_id = df.src_id AND r.pos < df.pos AND NOT (r.decorates AND r.indent = df.indent)), 0) + 1 AS first FROM df),
ar AS (SELECT d.src_id, d.pos, string_agg(e.name, '.' ORDER BY e.pos) AS names, bool_and(e.inside) AS ok FROM dl d JOIN dl e ON e.src_id = d.src_id AND e.pos < d.pos AND e.indent < d.indent AND e.last >= d.pos GROUP BY 1, 2),
bd AS (SELECT d.src_id, CASE WHEN ar.names IS NULL THEN d.name ELSE ar.names || '.' || d.name END AS qualified_name, d.pos, d.last,
  regexp_replace(regexp_replace(regexp_replace(array_to_string(s[d.first:d.last], chr(10)), {sql_text(S.STRINGS)}, '\"\"', 'g'), '#[^\n]*', '', 'g'), '\\b(def|class)[ \t]+\\w+', '\\1', 'g') AS body, d.name AS short
  FROM dl d JOIN ls ON ls.src_id = d.src_id LEFT JOIN ar ON ar.src_id = d.src_id AND ar.pos = d.pos WHERE d.inside AND coalesce(ar.ok, true)),
blk AS (SELECT src_id, short, qualified_name, pos::BIGINT AS start_line, last::BIGINT AS end_line, list_sort(list_filter(list_distinct(regexp_extract_all(body, {sql_text(S.CALL)}, 1)), lambda x: NOT list_contains({S.PYTHON_WORDS}, x))) AS calls FROM bd)"""
_LINE_SYM = f"""{_FILES}, {_sql_symbols("files", "src_id", "content", "t")},
sym AS (SELECT repo, git_ref, path, name, start_line, end_line, calls, path || ':' || name || ':' || start_line AS id FROM tsym JOIN files USING (src_id))"""


def sql_parsed() -> str:
    """The CTE ``sym`` of the symbols of the CTE ``files``: blocks of Python, and lines of all files without any."""
    return f"""{_BLOCKS.replace("WHERE path LIKE '%.py'", f"WHERE {_PYTHON}")}, {_sql_symbols("(SELECT * FROM files WHERE src_id NOT IN (SELECT src_id FROM blk))", "src_id", "content", "t")},
allsym AS (SELECT src_id, short AS name, qualified_name, start_line, end_line, calls FROM blk UNION ALL SELECT src_id, name, name, start_line, end_line, calls FROM tsym),
sym AS (SELECT src_id, repo, git_ref, path, name, start_line, end_line, calls, path || ':' || qualified_name || ':' || start_line AS id FROM allsym JOIN files USING (src_id))"""


_SYM = f"{_FILES}, {sql_parsed()}"
_EDGES = f"""{_SYM},
calls AS (SELECT DISTINCT repo, git_ref, id AS caller_id, unnest(calls) AS name FROM sym),
edges AS (SELECT DISTINCT c.repo, c.git_ref, s.id AS callee_id, c.caller_id FROM calls c JOIN sym s ON s.repo = c.repo AND s.git_ref = c.git_ref AND s.name = c.name WHERE s.id <> c.caller_id)"""
_TWO = """one AS (SELECT repo, git_ref, callee_id AS symbol_id, caller_id FROM edges),
two AS (SELECT DISTINCT a.repo, a.git_ref, a.symbol_id, b.caller_id FROM one a JOIN one b ON b.repo = a.repo AND b.git_ref = a.git_ref AND b.symbol_id = a.caller_id EXCEPT SELECT * FROM one)"""
_NORM = "CASE WHEN starts_with(trim(specifier), '.') THEN regexp_replace(trim(specifier), '^[./]+', '') ELSE trim(specifier) END"
_DEPS = f"""spec AS (SELECT DISTINCT src_id, repo, git_ref, path, unnest(CASE WHEN path LIKE '%.py' THEN
  list_concat(list_transform(flatten(list_transform(regexp_extract_all(content, {sql_text(S.PYTHON_IMPORT)}, 1), lambda x: string_split(x, ','))), lambda x: string_split(trim(x), '.')[1]), regexp_extract_all(content, {sql_text(S.PYTHON_FROM)}, 1))
  ELSE list_concat({", ".join(f"regexp_extract_all(content, {sql_text(p)}, 1)" for p in S.QUOTED_IMPORTS)}) END) AS specifier FROM files WHERE content IS NOT NULL AND {_EXT}),
deps AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(string_split({_NORM}, '/')[-1], '\\.py$', ''), '\\.js$', ''), '\\.ts$', '') AS dependency FROM spec WHERE specifier <> '')"""
_PATH_KEYS = """pk AS (SELECT DISTINCT repo, git_ref, path, unnest([path, bare, string_split(bare, '/')[-1], replace(bare, '/', '.')]
  || CASE WHEN string_split(bare, '/')[-1] = 'index' AND contains(bare, '/') THEN [regexp_replace(bare, '/[^/]*$', ''), string_split(bare, '/')[-2]] ELSE [] END) AS key
  FROM (SELECT repo, git_ref, path, regexp_replace(path, '\\.[^./]*$', '') AS bare FROM files))"""
_DEPENDENTS = f"""{_DEPS}, {_PATH_KEYS},
dep AS (SELECT DISTINCT pk.repo, pk.git_ref, pk.path, deps.path AS dependent FROM pk JOIN deps ON deps.repo = pk.repo AND deps.git_ref = pk.git_ref AND deps.dependency = pk.key WHERE deps.path <> pk.path)"""

_TEXT_KEYS = "unnest([trim(specifier), bare, string_split(bare, '/')[-1]] || CASE WHEN starts_with(trim(specifier), '.') THEN [regexp_replace(trim(specifier), '^[./]+', ''), regexp_replace(bare, '^[./]+', '')] ELSE [] END)"
_RESOLVED = f"""roots AS (SELECT DISTINCT repo, git_ref, path, specifier, CASE
  WHEN starts_with(specifier, './') THEN regexp_replace(path, '[^/]*$', '') || specifier[3:]
  WHEN starts_with(specifier, '../') THEN regexp_replace(path, '[^/]*/[^/]*$', '') || specifier[4:]
  WHEN starts_with(specifier, '@/') THEN specifier[3:] END AS root FROM deps),
cand AS (SELECT *, unnest(CASE WHEN regexp_matches(root, '\\.(tsx?|jsx?)$') THEN [root] ELSE [root || '.ts', root || '.tsx', root || '.js', root || '.jsx', root || '/index.ts', root || '/index.tsx', root || '/index.js', root || '/index.jsx'] END) AS target FROM roots WHERE root IS NOT NULL),
keys AS (SELECT c.repo, c.git_ref, c.path, c.specifier, pk.key FROM cand c JOIN pk ON pk.repo = c.repo AND pk.git_ref = c.git_ref AND pk.path = c.target
  UNION SELECT repo, git_ref, path, specifier, {_TEXT_KEYS}
  FROM (SELECT *, regexp_replace(trim(specifier), '\\.(tsx?|jsx?)$', '') AS bare FROM deps)),
resolved AS (SELECT DISTINCT k.repo, k.git_ref, k.path, k.specifier, f.path AS target FROM keys k JOIN files f ON f.repo = k.repo AND f.git_ref = k.git_ref AND (f.path = k.key OR regexp_replace(f.path, '\\.[^./]*$', '') = k.key))"""


def _sql_bound(source: str, whole: str, renamed: str) -> str:
    return f"""SELECT repo, git_ref, path, z[2] AS specifier, regexp_extract(z[1], {sql_text(S.BARE_NAME)}, 1) AS local_name, '{whole}' AS imported_name FROM {source}
 UNION ALL SELECT repo, git_ref, path, z[2], regexp_extract(z[1], {sql_text(S.STAR_NAME)}, 1), '*' FROM {source}
 UNION ALL SELECT repo, git_ref, path, m, coalesce(nullif(regexp_extract(x, {sql_text(renamed)}, 2), ''), regexp_extract(x, {sql_text(renamed)}, 1)), regexp_extract(x, {sql_text(renamed)}, 1)
  FROM (SELECT repo, git_ref, path, z[2] AS m, unnest(list_transform(string_split(regexp_extract(z[1], '\\{{([^}}]*)\\}}', 1), ','), lambda y: trim(regexp_replace(y, '\\s+', ' ', 'g')))) AS x FROM {source}) WHERE regexp_matches(x, {sql_text(renamed)})"""


_SCRIPTS = "FROM files WHERE content IS NOT NULL AND " + _EXT.replace("py|", "")
_BOUND = f"""st_d AS (SELECT repo, git_ref, path, unnest(list_zip(regexp_extract_all(content, {sql_text(S.IMPORT_CLAUSE)}, 1), regexp_extract_all(content, {sql_text(S.IMPORT_CLAUSE)}, 2))) AS z {_SCRIPTS}),
st_r AS (SELECT repo, git_ref, path, unnest(list_zip(regexp_extract_all(content, {sql_text(S.REQUIRE_CLAUSE)}, 1), regexp_extract_all(content, {sql_text(S.REQUIRE_CLAUSE)}, 2))) AS z {_SCRIPTS}),
bound AS (SELECT DISTINCT * FROM ({_sql_bound("st_d", "default", S.IMPORT_RENAMED)} UNION ALL {_sql_bound("st_r", "*", S.REQUIRE_RENAMED)}) WHERE local_name <> '')"""

_STEM = lambda e: f"regexp_replace(string_split({e}, '/')[-1], '([^/])\\.[^.]*$', '\\1')"

ORACLES = {
    "test_targets": f"""WITH {_FILES}, f AS (SELECT repo, git_ref, path, {_STEM("path")} AS stem FROM files WHERE NOT regexp_matches(path, '(^|/)test_[^/]*$')),
t AS (SELECT repo, git_ref, path AS test_path, {_STEM("path")} AS ts FROM files WHERE regexp_matches(path, '(^|/)test_[^/]*$'))
SELECT f.repo, f.git_ref, f.path, test_path FROM f LEFT JOIN t ON t.repo = f.repo AND t.git_ref = f.git_ref AND (contains(ts, stem) OR contains(stem, ts))""",
    "snapshot_cap": f"""WITH {_FILES}, r AS (SELECT repo, git_ref, path, src_id, row_number() OVER (PARTITION BY repo, git_ref ORDER BY path) AS n FROM files
 WHERE {_EXT.replace("jsx|ts|tsx)", "jsx|ts|tsx|json)")} AND coalesce(size_bytes, 0) <= 250000) SELECT repo, git_ref, path, src_id FROM r WHERE n <= 500""",
    "parsed_symbols": f"WITH {_SYM} SELECT id, repo, git_ref, name, end_line::BIGINT AS end_line, array_to_string(list_sort(calls), ' ') AS calls FROM sym",
    "text_symbols": f"WITH {_LINE_SYM} SELECT id, repo, git_ref, end_line::BIGINT AS end_line, len(calls)::BIGINT AS n_calls FROM sym",
    "python_blocks": f"""WITH {_FILES}, {_BLOCKS} SELECT src_id, qualified_name, start_line, end_line, array_to_string(calls, ' ') AS calls FROM blk""",
    "text_dependencies": f"WITH {_FILES}, {_DEPS} SELECT src_id, specifier, dependency FROM deps",
    "caller_edges": f"WITH {_EDGES} SELECT * FROM edges",
    "callers_depth2": f"WITH {_EDGES}, {_TWO} SELECT *, 1 AS depth FROM one UNION ALL SELECT *, 2 FROM two",
    "dependents": f"WITH {_FILES}, {_DEPENDENTS} SELECT * FROM dep",
    "import_resolve": f"WITH {_FILES}, {_DEPS}, {_PATH_KEYS}, {_RESOLVED} SELECT * FROM resolved",
    "script_imports": f"WITH {_FILES}, {_BOUND} SELECT * FROM bound",
    "import_callers": f"""WITH {_SYM}, {_DEPS}, {_PATH_KEYS}, {_RESOLVED}, {_BOUND},
miss AS (SELECT DISTINCT repo, git_ref, path, specifier FROM deps WHERE (repo, git_ref, path, specifier) IN (SELECT repo, git_ref, path, specifier FROM bound) EXCEPT SELECT repo, git_ref, path, specifier FROM resolved),
fall AS (SELECT DISTINCT m.repo, m.git_ref, m.path, m.specifier, i.path AS target FROM (SELECT DISTINCT repo, git_ref, path, specifier, {_TEXT_KEYS} AS key FROM (SELECT *, regexp_replace(trim(specifier), '\\.(tsx?|jsx?)$', '') AS bare FROM miss)) m
  JOIN deps i ON i.repo = m.repo AND i.git_ref = m.git_ref AND i.dependency = m.key WHERE m.key NOT IN ('', '.')),
tg AS (SELECT * FROM resolved UNION SELECT * FROM fall),
cl AS (SELECT repo, git_ref, path, id AS caller_id, unnest(calls) AS local_name FROM sym)
SELECT DISTINCT cl.repo, cl.git_ref, s.id AS callee_id, cl.caller_id FROM cl JOIN bound b ON b.repo = cl.repo AND b.git_ref = cl.git_ref AND b.path = cl.path AND b.local_name = cl.local_name
 JOIN tg ON tg.repo = cl.repo AND tg.git_ref = cl.git_ref AND tg.path = cl.path AND tg.specifier = b.specifier
 JOIN sym s ON s.repo = cl.repo AND s.git_ref = cl.git_ref AND s.path = tg.target WHERE (b.imported_name IN ('*', 'default') OR b.imported_name = s.name) AND s.id <> cl.caller_id""",
    "changed_symbols": f"""WITH {_PL}, {_sql_symbols("diff_files", "diff_id", "full_content", "f")},
a AS (SELECT *, starts_with(line, '+') AND NOT starts_with(line, '+++') AND NOT head AS add, CASE WHEN head OR (starts_with(line, '-') AND NOT starts_with(line, '---')) THEN 0 ELSE 1 END AS step FROM pl),
c AS (SELECT *, max(CASE WHEN head THEN regexp_extract(line, {sql_text(D.HUNK)}, 3)::BIGINT END) OVER (PARTITION BY diff_id, hunk_no)
  + coalesce(sum(step) OVER (PARTITION BY diff_id, hunk_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ln FROM a),
ad AS (SELECT DISTINCT diff_id, ln FROM c WHERE add)
SELECT DISTINCT s.diff_id, name, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line FROM fsym s JOIN ad ON ad.diff_id = s.diff_id AND ln BETWEEN start_line AND end_line
UNION ALL SELECT diff_id, name, start_line, end_line FROM fsym s WHERE diff_id NOT IN (SELECT diff_id FROM ad)""",
    "context_topk": f"""WITH {_EDGES}, {_TWO}, {_DEPENDENTS},
near AS (SELECT *, {G.DIRECT} AS score FROM one UNION ALL SELECT *, {G.SECOND} FROM two),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, git_ref, path ORDER BY start_line, id) AS n FROM sym) WHERE n <= {G.DEPENDENT_SYMBOLS}),
al AS (SELECT s.repo, s.git_ref, s.path, near.caller_id AS sid, score FROM sym s JOIN near ON near.repo = s.repo AND near.git_ref = s.git_ref AND near.symbol_id = s.id
  UNION ALL SELECT a.repo, a.git_ref, a.path, b.id, {G.CALLEE} FROM (SELECT DISTINCT repo, git_ref, path, unnest(calls) AS cn FROM sym) a JOIN sym b ON b.repo = a.repo AND b.git_ref = a.git_ref AND b.name = a.cn
  UNION ALL SELECT dep.repo, dep.git_ref, dep.path, f.id, {G.DEPENDENT} FROM dep JOIN firsts f ON f.repo = dep.repo AND f.git_ref = dep.git_ref AND f.path = dep.dependent),
best AS (SELECT repo, git_ref, path, sid, max(score) AS score FROM al GROUP BY ALL),
rk AS (SELECT best.repo, best.git_ref, best.path, sid, score, row_number() OVER (PARTITION BY best.repo, best.git_ref, best.path ORDER BY score DESC, s.path, s.start_line, sid) AS rank
  FROM best JOIN sym s ON s.repo = best.repo AND s.git_ref = best.git_ref AND s.id = best.sid WHERE best.path <> s.path OR score >= {G.SAME_FILE_LEAST})
SELECT repo, git_ref, path, rank, sid AS symbol_id, score::BIGINT AS score FROM rk WHERE rank <= {G.CONTEXT_LIMIT}""",
    "impact_risk": f"""WITH {_EDGES}, {_DEPENDENTS},
d1 AS (SELECT DISTINCT s.repo, s.git_ref, s.path, e.caller_id FROM sym s JOIN edges e ON e.repo = s.repo AND e.git_ref = s.git_ref AND e.callee_id = s.id),
d2 AS (SELECT DISTINCT d1.repo, d1.git_ref, d1.path, e.caller_id FROM d1 JOIN edges e ON e.repo = d1.repo AND e.git_ref = d1.git_ref AND e.callee_id = d1.caller_id EXCEPT SELECT * FROM d1),
cnt AS (SELECT f.repo, f.git_ref, f.path, coalesce(n.c, 0) AS c, coalesce(a.c, 0) AS a, coalesce(b.c, 0) AS b, coalesce(k.c, 0) AS k, concat_ws(' ', f.path, n.names) AS txt FROM files f
  LEFT JOIN (SELECT repo, git_ref, path, count(*) AS c, string_agg(DISTINCT name, ' ' ORDER BY name) AS names FROM sym GROUP BY 1, 2, 3) n USING (repo, git_ref, path)
  LEFT JOIN (SELECT repo, git_ref, path, count(*) AS c FROM d1 GROUP BY 1, 2, 3) a USING (repo, git_ref, path)
  LEFT JOIN (SELECT repo, git_ref, path, count(*) AS c FROM d2 GROUP BY 1, 2, 3) b USING (repo, git_ref, path)
  LEFT JOIN (SELECT repo, git_ref, path, count(*) AS c FROM dep GROUP BY 1, 2, 3) k USING (repo, git_ref, path)),
sc AS (SELECT *, list_filter({G.RISK_WORDS}, lambda w: contains(lower(txt), w)) AS hit FROM cnt),
fin AS (SELECT *, least(100, 10 + CASE WHEN c > 0 THEN least(25, 5 * c) ELSE 15 END + least(30, 7 * a) + least(15, 3 * b) + least(20, 4 * k) + CASE WHEN len(hit) > 0 THEN 20 ELSE 0 END)::BIGINT AS risk_score FROM sc)
SELECT repo, git_ref, path, risk_score, CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 35 THEN 'medium' ELSE 'low' END AS risk_level,
 concat_ws('; ', CASE WHEN c > 0 THEN c || ' changed symbol(s)' ELSE 'file-level or unscoped change' END, CASE WHEN a > 0 THEN a || ' direct caller(s)' END, CASE WHEN b > 0 THEN b || ' transitive caller(s)' END,
  CASE WHEN k > 0 THEN k || ' importing/dependent file(s)' END, CASE WHEN len(hit) > 0 THEN 'sensitive path: ' || array_to_string(hit[1:5], ', ') END) AS reasons FROM fin""",
}
