"""The graph of a repository snapshot: callers, imports, dependents, context and risk of a change.

Every join is an equi-join inside one snapshot (repo, git_ref); theta conditions are only residuals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkyard.functions.payloads import without_json_comments

NS = ["repo", "git_ref"]
EXTENSIONS = [".ts", ".tsx", ".js", ".jsx"]
CONTEXT_LIMIT = 8
DEPENDENT_SYMBOLS = 3

# Scores of related symbols, and words that make a path or name sensitive.
DIRECT, SECOND, CALLEE, DEPENDENT, SAME_FILE_LEAST = 100, 70, 55, 45, 80
LEVELS = ["low", "medium", "high", "critical"]
RISK_WORDS = ["admin", "auth", "billing", "delete", "execute", "login", "password", "payment", "permission", "query", "secret", "sql", "token"]


def symbol_id(path: Column, name: Column, line: Column) -> Column:
    return F.concat_ws(":", path, name, line.cast("string"))


def normal_path(c: Column) -> Column:
    """A path without empty and . parts; .. takes the part before it away."""
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x))
    return F.array_join(F.aggregate(F.split(c, "/"), F.expr("cast(array() as array<string>)"), step), "/")


def without_suffix(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def path_keys(path: Column) -> Column:
    """The names by which a file may be imported: path, without suffix, last part, dotted; for an index its folder."""
    bare = without_suffix(path)
    last = F.element_at(F.split(bare, "/"), -1)
    folder = F.regexp_replace(bare, "/?[^/]*$", "")
    base = F.array(path, bare, last, F.replace(bare, F.lit("/"), F.lit(".")))
    extra = F.when((last == "index") & (folder != ""), F.array(folder, F.element_at(F.split(folder, "/"), -1))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(base, extra), lambda x: x != ""))


def specifier_keys(spec: Column) -> Column:
    """The names that the text of an import itself stands for."""
    strip = lambda x: F.regexp_replace(x, r"\.(?:tsx?|jsx?)$", "")
    clean = F.trim(spec)
    bare = strip(clean)
    rel = F.regexp_replace(clean, r"^[./]+", "")
    more = F.when(clean.startswith("."), F.array(rel, strip(rel))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(F.array(clean, bare, F.element_at(F.split(bare, "/"), -1)), more), lambda x: ~x.isin("", ".")))


def candidate_paths(importer: Column, spec: Column, base: Column | None = None) -> Column:
    """Paths that a relative, rooted or aliased import may mean: as written, with a suffix, or as a folder's index."""
    base = base if base is not None else F.lit("")
    folder = F.regexp_replace(importer, "/?[^/]*$", "")
    root = (
        F.when(spec.startswith("."), F.concat_ws("/", folder, spec))
        .when(spec.startswith("@/"), F.concat_ws("/", base, F.substring(spec, 3, 1_000_000)))
        .when(spec.startswith("/"), F.concat_ws("/", base, F.substring(spec, 2, 1_000_000)))
        .when(base != "", F.concat_ws("/", base, spec))
    )
    r = normal_path(root)
    made = F.array(*(F.concat(r, F.lit(x)) for x in EXTENSIONS), *(F.concat(r, F.lit(f"/index{x}")) for x in EXTENSIONS))
    return F.when(root.isNull(), F.array().cast("array<string>")).when(F.rlike(r, F.lit(r"\.(?:tsx?|jsx?)$")), F.array(r)).otherwise(made)


def module_configs(files: DataFrame, content: str = "content") -> DataFrame:
    """``repo, git_ref, dir, base, paths`` of the tsconfig.json and jsconfig.json files of a snapshot.

    Comments are allowed. A file that does not parse is left out; without baseUrl the base is the file's own folder.
    """
    kind = "struct<compilerOptions: struct<baseUrl: string, paths: map<string, array<string>>>>"
    f = files.where(F.rlike("path", F.lit(r"(?:^|/)(?:ts|js)config\.json$")))
    j = f.withColumn("j", F.from_json(without_json_comments(F.col(content)), kind)).where(F.try_parse_json(without_json_comments(F.col(content))).isNotNull())
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    base = normal_path(F.concat_ws("/", folder, F.coalesce(F.col("j.compilerOptions.baseUrl"), F.lit(""))))
    return j.select(*NS, folder.alias("dir"), base.alias("base"), F.coalesce(F.col("j.compilerOptions.paths"), F.expr("map()").cast("map<string,array<string>>")).alias("paths"))


def with_config(imports: DataFrame, configs: DataFrame) -> DataFrame:
    """``imports`` with ``base`` and ``paths`` of the config in the deepest folder above the importing file.

    The folders above a file are exploded and looked up by equality, so no join by prefix is needed.
    """
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    spec = imports.select(*NS, "path", "specifier").distinct()
    near = spec.select(*NS, "path").distinct().withColumn("dir", F.explode(ups)).join(configs, [*NS, "dir"])
    deepest = near.groupBy(*NS, "path").agg(F.max_by(F.struct("base", "paths"), F.length("dir")).alias("c"))
    return spec.join(deepest, [*NS, "path"], "left").select(*NS, "path", "specifier", F.coalesce("c.base", F.lit("")).alias("base"), F.col("c.paths").alias("paths"))


def _alias_roots(spec: Column, base: Column, paths: Column) -> Column:
    """What an import means under the aliases of its config; a star stands for any text."""

    def one(e: Column) -> Column:
        head, tail = F.substring_index(e["key"], "*", 1), F.substring(e["key"], F.instr(e["key"], "*") + 1, F.length(e["key"]))
        star = F.instr(e["key"], "*") > 0
        fits = F.when(star, spec.startswith(head) & spec.endswith(tail)).otherwise(spec == e["key"])
        inner = F.substring(spec, F.length(head) + 1, F.length(spec) - F.length(head) - F.length(tail))
        made = F.transform(e["value"], lambda t: F.concat_ws("/", base, F.when(star, F.replace(t, F.lit("*"), inner)).otherwise(t)))
        return F.when(fits, made).otherwise(F.array().cast("array<string>"))

    return F.coalesce(F.flatten(F.transform(F.map_entries(paths), one)), F.array().cast("array<string>"))


def resolve_imports(imports: DataFrame, files: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """``repo, git_ref, path, specifier, target``: the files of the snapshot that each import means.

    ``imports``: repo, git_ref, path, specifier; ``files``: repo, git_ref, path; ``configs`` as :func:`module_configs`.
    Files found by candidate paths lend their own names to the search, as does the text of the import. Aliases come
    before rooted paths, and only an import that is not relative uses them.
    """
    there = files.select(*NS, F.col("path").alias("target")).distinct()
    if configs is None:
        spec = imports.select(*NS, "path", "specifier").distinct()
        cand = candidate_paths(F.col("path"), F.col("specifier"))
    else:
        spec = with_config(imports, configs)
        alias = F.when(F.col("specifier").startswith("."), F.array().cast("array<string>")).otherwise(_alias_roots(F.col("specifier"), F.col("base"), F.col("paths")))
        by_alias = F.flatten(F.transform(alias, lambda r: candidate_paths(F.lit(""), F.concat(F.lit("/"), r))))
        cand = F.when(F.size(alias) > 0, by_alias).otherwise(candidate_paths(F.col("path"), F.col("specifier"), F.col("base")))
    found = spec.select(*NS, "path", "specifier", F.explode(cand).alias("target")).join(there, [*NS, "target"], "left_semi")
    by_found = found.select(*NS, "path", "specifier", F.explode(path_keys(F.col("target"))).alias("key"))
    by_text = spec.select(*NS, "path", "specifier", F.explode(specifier_keys(F.col("specifier"))).alias("key"))
    keys = by_found.unionByName(by_text).distinct()
    names = there.select(*NS, "target", F.explode(F.array_distinct(F.array("target", without_suffix(F.col("target"))))).alias("key"))
    return keys.join(names, [*NS, "key"]).select(*NS, "path", "specifier", "target").distinct()


def targets_or_importers(resolved: DataFrame, asked: DataFrame, dependencies: DataFrame) -> DataFrame:
    """``repo, git_ref, path, specifier, target``: the files an import means or, where there is none, the files that import the same name.

    ``resolved`` as :func:`resolve_imports` gives it for the imports ``asked``: repo, git_ref, path, specifier;
    ``dependencies``: repo, git_ref, path, dependency of all files.
    """
    none = asked.select(*NS, "path", "specifier").distinct().join(resolved.select(*NS, "path", "specifier").distinct(), [*NS, "path", "specifier"], "left_anti")
    keys = none.select(*NS, "path", "specifier", F.explode(specifier_keys(F.col("specifier"))).alias("dependency"))
    importers = dependencies.select(*NS, F.col("path").alias("target"), "dependency").distinct()
    return resolved.unionByName(keys.join(importers, [*NS, "dependency"]).select(*NS, "path", "specifier", "target").distinct())


def dependents(dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """``repo, git_ref, path, dependent``: the files that import a name under which ``path`` may be imported."""
    keys = files.select(*NS, "path", F.explode(path_keys(F.col("path"))).alias("key"))
    deps = dependencies.select(*NS, F.col("path").alias("dependent"), F.col("dependency").alias("key")).distinct()
    return keys.join(deps, [*NS, "key"]).where("path <> dependent").select(*NS, "path", "dependent").distinct()


def caller_edges(symbols: DataFrame) -> DataFrame:
    """``repo, git_ref, callee_id, caller_id`` of every call by name; a symbol does not call itself."""
    calls = symbols.select(*NS, F.col("id").alias("caller_id"), F.explode("calls").alias("name"))
    named = symbols.select(*NS, F.col("id").alias("callee_id"), "name")
    return calls.join(named, [*NS, "name"]).where("caller_id <> callee_id").select(*NS, "callee_id", "caller_id").distinct()


def imported_callers(symbols: DataFrame, bindings: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges of calls to a name that an import binds: ``bindings`` has path, local_name, imported_name, specifier.

    A whole-module binding (null or *) means every symbol of the target, ``default`` its top-level ones (all, where it has
    none), any other name the symbols of that name or whose qualified name ends with it. Symbols without a qualified
    name are top-level.
    """
    qualified = F.coalesce("qualified_name", "name") if "qualified_name" in symbols.columns else F.col("name")
    calls = symbols.select(*NS, "path", F.col("id").alias("caller_id"), F.explode("calls").alias("local_name"))
    b = calls.join(bindings.select(*NS, "path", "local_name", "imported_name", "specifier"), [*NS, "path", "local_name"]).join(targets, [*NS, "path", "specifier"])
    s = symbols.select(*NS, F.col("path").alias("target"), F.col("id").alias("callee_id"), F.col("name").alias("callee_name"), qualified.alias("callee_qualified"))
    top = s.groupBy(*NS, "target").agg(F.max(~F.contains("callee_qualified", F.lit("."))).alias("has_top"))
    s = s.join(top, [*NS, "target"])
    named = (F.col("callee_name") == F.col("imported_name")) | F.endswith("callee_qualified", F.concat(F.lit("."), F.col("imported_name")))
    ok = F.when(F.coalesce(F.col("imported_name"), F.lit("*")) == "*", True).when(F.col("imported_name") == "default", ~F.col("has_top") | ~F.contains("callee_qualified", F.lit("."))).otherwise(named)
    return b.join(s, [*NS, "target"]).where(ok & (F.col("caller_id") != F.col("callee_id"))).select(*NS, "callee_id", "caller_id").distinct()


def callers_within_two(edges: DataFrame) -> DataFrame:
    """``repo, git_ref, symbol_id, caller_id, depth``: direct callers (1) and those of direct callers that are none (2).

    A symbol reached again by its own callers counts, as seeds are not marked beforehand.
    """
    one = edges.select(*NS, F.col("callee_id").alias("symbol_id"), "caller_id")
    up = edges.select(*NS, F.col("callee_id").alias("caller_id"), F.col("caller_id").alias("second"))
    two = one.join(up, [*NS, "caller_id"]).select(*NS, "symbol_id", F.col("second").alias("caller_id")).distinct()
    two = two.join(one, [*NS, "symbol_id", "caller_id"], "left_anti")
    return one.withColumn("depth", F.lit(1)).unionByName(two.withColumn("depth", F.lit(2)))


def callers_of_files(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``repo, git_ref, path, caller_id, depth`` with all symbols of a file as seeds of one search."""
    own = symbols.select(*NS, "path", F.col("id").alias("callee_id"))
    one = own.join(edges, [*NS, "callee_id"]).select(*NS, "path", "caller_id").distinct()
    up = edges.select(*NS, F.col("callee_id").alias("caller_id"), F.col("caller_id").alias("second"))
    two = one.join(up, [*NS, "caller_id"]).select(*NS, "path", F.col("second").alias("caller_id")).distinct().join(one, [*NS, "path", "caller_id"], "left_anti")
    return one.withColumn("depth", F.lit(1)).unionByName(two.withColumn("depth", F.lit(2)))


def related_symbols(symbols: DataFrame, edges: DataFrame, depends: DataFrame, limit: int = CONTEXT_LIMIT) -> DataFrame:
    """``repo, git_ref, path, rank, symbol_id, score``: the symbols most worth showing with a changed file."""
    own = symbols.select(*NS, "path", F.col("id").alias("sid"), "calls")
    where = symbols.select(*NS, F.col("id").alias("symbol_id"), F.col("path").alias("at_path"), F.col("start_line").alias("at_line"), F.col("name").alias("at_name"))
    near = callers_within_two(edges).select(*NS, F.col("symbol_id").alias("sid"), F.col("caller_id").alias("symbol_id"), F.when(F.col("depth") == 1, DIRECT).otherwise(SECOND).alias("score"))
    a = own.join(near, [*NS, "sid"]).select(*NS, "path", "symbol_id", "score")
    b = own.select(*NS, "path", F.explode("calls").alias("at_name")).distinct().join(where, [*NS, "at_name"]).select(*NS, "path", "symbol_id", F.lit(CALLEE).alias("score"))
    first = where.withColumn("n", F.row_number().over(Window.partitionBy(*NS, "at_path").orderBy("at_line", "symbol_id"))).where(F.col("n") <= DEPENDENT_SYMBOLS)
    c = depends.join(first.select(*NS, F.col("at_path").alias("dependent"), "symbol_id"), [*NS, "dependent"]).select(*NS, "path", "symbol_id", F.lit(DEPENDENT).alias("score"))
    best = a.unionByName(b).unionByName(c).groupBy(*NS, "path", "symbol_id").agg(F.max("score").alias("score"))
    j = best.join(where.drop("at_name"), [*NS, "symbol_id"]).where((F.col("path") != F.col("at_path")) | (F.col("score") >= SAME_FILE_LEAST))
    w = Window.partitionBy(*NS, "path").orderBy(F.desc("score"), "at_path", "at_line", "symbol_id")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(*NS, "path", F.col("rank").cast("bigint").alias("rank"), "symbol_id", "score")


def risk(changed: Column, direct: Column, second: Column, depend: Column, text: Column) -> tuple[Column, Column, Column]:
    """Score from 0 to 100, level and reasons of a change, from its counts and the text that may be sensitive."""
    low = F.lower(text)
    hit = F.filter(F.array(*map(F.lit, RISK_WORDS)), lambda w: F.contains(low, w))
    parts = [
        F.when(changed > 0, F.least(F.lit(25), changed * 5)).otherwise(15),
        F.least(F.lit(30), direct * 7),
        F.least(F.lit(15), second * 3),
        F.least(F.lit(20), depend * 4),
        F.when(F.size(hit) > 0, 20).otherwise(0),
    ]
    score = F.least(F.lit(100), F.lit(10) + sum(parts[1:], parts[0])).cast("bigint")
    level = F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 35, "medium").otherwise("low")
    say = lambda n, what: F.when(n > 0, F.concat(n.cast("string"), F.lit(what)))
    reasons = F.concat_ws("; ", F.coalesce(say(changed, " changed symbol(s)"), F.lit("file-level or unscoped change")), say(direct, " direct caller(s)"), say(second, " transitive caller(s)"), say(depend, " importing/dependent file(s)"), F.when(F.size(hit) > 0, F.concat(F.lit("sensitive path: "), F.array_join(F.slice(hit, 1, 5), ", "))))
    return score, level, reasons


def repo_map(functions: DataFrame, most: int = 20) -> DataFrame:
    """``repo, git_ref, name, path, start_line, n_callers, callers`` of each function by its bare name.

    Of several functions of a name the last by path and line counts. ``callers`` names the first ``most`` of them.
    """
    nodes = functions.groupBy(*NS, "name").agg(F.max(F.struct("path", "start_line", "calls")).alias("v")).select(*NS, "name", "v.*")
    calls = nodes.select(*NS, F.col("name").alias("caller"), F.concat(F.lit("`"), F.col("name"), F.lit("` ("), F.element_at(F.split("path", "/"), -1), F.lit(":"), F.col("start_line").cast("string"), F.lit(")")).alias("text"), F.explode("calls").alias("name"))
    w = Window.partitionBy(*NS, "name").orderBy("caller")
    shown = calls.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).groupBy(*NS, "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), ", ").alias("callers"))
    size = calls.groupBy(*NS, "name").agg(F.count("*").alias("n_callers"))
    return nodes.drop("calls").join(size, [*NS, "name"], "left").join(shown, [*NS, "name"], "left").select(*NS, "name", "path", "start_line", F.coalesce("n_callers", F.lit(0)).alias("n_callers"), F.coalesce("callers", F.lit("no known callers")).alias("callers"))


def _parts_of(stem: Column) -> Column:
    """Every part of a name, so that containment becomes equality."""
    n = F.length(stem)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(stem, i, k)))))


def test_targets(files: DataFrame, tests: DataFrame) -> DataFrame:
    """``repo, git_ref, path, test_path`` of the tests to run for each file; a null test means all of them.

    A test fits a file if one's name without suffix contains the other's. The parts of names are joined by equality, so
    files and tests of a snapshot are never paired with each other.
    """
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"(?<=.)\.[^.]*$", "")
    f = files.select(*NS, "path", stem(F.col("path")).alias("stem"))
    t = tests.select(*NS, F.col("path").alias("test_path"), stem(F.col("path")).alias("test_stem"))
    inside = f.join(t.select(*NS, "test_path", F.explode(_parts_of(F.col("test_stem"))).alias("stem")), [*NS, "stem"]).select(*NS, "path", "test_path")
    around = f.select(*NS, "path", F.explode(_parts_of(F.col("stem"))).alias("test_stem")).join(t, [*NS, "test_stem"]).select(*NS, "path", "test_path")
    hit = inside.unionByName(around).distinct()
    return f.select(*NS, "path").distinct().join(hit, [*NS, "path"], "left")
