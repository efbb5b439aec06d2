"""Definitions, calls and imports read from source texts, as rows."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkyard.functions import text as T
from hunkyard.functions.arrays import rows_of

# How a line that defines something looks; the first form that fits gives the name.
DEFINITIONS = [
    r"^\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(",
    r"^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)\b",
    r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\(",
    r"^\s*(?:export\s+)?class\s+([A-Za-z_$][A-Za-z0-9_$]*)\b",
    r"^\s*(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(?:async\s*)?\(",
]
DEFINING = r"\b(?:def|class|function|const|let|var)\b"
CALL = r"\b([A-Za-z_$][A-Za-z0-9_$]*)\s*\("
PYTHON_IMPORT = r"(?m)^[ \t]*import[ \t]+([A-Za-z0-9_., \t]+)"
PYTHON_FROM = r"(?m)^[ \t]*from[ \t]+([A-Za-z0-9_.]+)[ \t]+import[ \t]+"
QUOTED_IMPORTS = [r"from\s+['\"]([^'\"]+)['\"]", r"import\s+['\"]([^'\"]+)['\"]", r"require\(['\"]([^'\"]+)['\"]\)"]
BLOCK = r"^[ \t]*(?:async[ \t]+)?(?:def|class)[ \t]+([A-Za-z_][A-Za-z0-9_]*)"
CLOSES = r"^[ \t]*(?:[)\]}]|\"\"\"|''')"
STRINGS = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
# Words of Python that may stand in front of a bracket and are no calls.
PYTHON_WORDS = ["and", "as", "assert", "async", "await", "class", "def", "del", "elif", "else", "except", "for", "from", "if", "import", "in", "is", "lambda", "not", "or", "raise", "return", "while", "with", "yield"]

# How names are bound by imports of scripts; the second group of the first two is the module.
IMPORT_CLAUSE = r"(?m)^[ \t]*import[ \t]+(?:type[ \t]+)?([^'\";]*?)[ \t]*from[ \t]*['\"]([^'\"]+)['\"]"
REQUIRE_CLAUSE = r"(?m)^[ \t]*(?:const|let|var)[ \t]+([^'\";=]*?)[ \t]*=[ \t]*require\(['\"]([^'\"]+)['\"]\)"
BARE_NAME = r"^[ \t]*([A-Za-z_$][A-Za-z0-9_$]*)"
STAR_NAME = r"\*[ \t]+as[ \t]+([A-Za-z_$][A-Za-z0-9_$]*)"
IMPORT_RENAMED = r"^(?:type )?([A-Za-z_$][A-Za-z0-9_$]*)(?: as ([A-Za-z_$][A-Za-z0-9_$]*))?$"
REQUIRE_RENAMED = r"^([A-Za-z_$][A-Za-z0-9_$]*)(?: ?: ?([A-Za-z_$][A-Za-z0-9_$]*))?$"


def definition_name(line: Column) -> Column:
    out = F.lit(None).cast("string")
    for p in reversed(DEFINITIONS):
        out = F.when(F.rlike(line, F.lit(p)), F.regexp_extract(line, p, 1)).otherwise(out)
    return out


def with_symbols(files: DataFrame, keep: list[str], content: str) -> DataFrame:
    """``keep`` and ``symbols``, an array of name, start_line, end_line, calls: what :func:`text_symbols` finds, in the file's own row.

    Lines and definitions are columns of their own, each used more than once, so that they are found once a file.
    """
    lines = files.select(*keep, T.lines(F.col(content)).alias("__lines"))
    found = F.filter(F.transform("__lines", lambda x, i: F.struct((i + 1).alias("at"), F.when(F.rlike(x, F.lit(DEFINING)), definition_name(x)).alias("name"))), lambda d: d["name"].isNotNull())
    defs = lines.select(*keep, "__lines", found.alias("__defs"))

    def symbol(d: Column, k: Column) -> Column:
        last = F.coalesce(F.get("__defs", k + 1)["at"] - 1, F.size("__lines"))
        body = F.array_join(F.slice("__lines", d["at"], last - d["at"] + 1), "\n")
        names = F.array_distinct(F.regexp_extract_all(body, F.lit(CALL), F.lit(1)))
        return F.struct(d["name"].alias("name"), d["at"].alias("start_line"), last.alias("end_line"), F.array_sort(F.array_remove(names, d["name"])).alias("calls"))

    return defs.select(*keep, F.transform("__defs", symbol).alias("symbols"))


def text_symbols(files: DataFrame, key: str, content: str) -> DataFrame:
    """``key, name, start_line, end_line, calls`` of each definition, by the forms of single lines. No shuffle.

    A body ends before the next definition of the file, or with the file. Calls are the names in front of an opening
    bracket in the body, each once, without the definition's own name. Null and empty texts have no definitions.
    """
    return rows_of(with_symbols(files, [key], content), [key], "symbols", "name")


def _masked(content: Column) -> Column:
    """A Python text whose strings of three quotes keep their line ends and quotes only."""
    for q in ('"""', "'''"):
        content = F.array_join(F.transform(F.split(content, q), lambda x, i: F.when(i % 2 == 1, F.regexp_replace(x, r"[^\n]", "")).otherwise(x)), q)
    return content


def with_blocks(files: DataFrame, keep: list[str], content: str) -> DataFrame:
    """``keep`` and ``blocks``, an array of name, qualified_name, start_line, end_line, calls: the definitions of a Python text
    by indentation, in the file's own row.

    A block ends before the next line that stands no deeper; lines that begin by closing brackets or
    with three quotes belong to it. A definition
    counts if nothing but definitions is around it (one inside an ``if`` does not), and its qualified name has all of these.
    Calls are those in its decorators and whole body, comments and strings left out.
    """
    text = F.coalesce(F.col(content), F.lit(""))
    f = files.select(*keep, T.lines(_masked(text)).alias("__lines"))
    one = lambda x, i: F.struct(
        (i + 1).alias("at"),
        F.length(F.regexp_extract(x, r"^([ \t]*)", 1)).alias("indent"),
        F.rlike(x, F.lit(CLOSES)).alias("closes"),
        F.nullif(F.regexp_extract(x, BLOCK, 1), F.lit("")).alias("name"),
        F.rlike(x, F.lit(r"^[ \t]*@")).alias("decorates"),
    )
    some = F.filter(F.transform("__lines", lambda x, i: F.when(F.rlike(x, F.lit(r"^[ \t]*[^\s#]")), one(x, i))), lambda r: r.isNotNull())
    f = f.select(*keep, "__lines", some.alias("__rows"))

    # one pass with a stack of the lines that the next one may stand inside; a definition is done when a line stands no deeper
    entry = "struct<indent:int,name:string,at:int,first:int,ok:boolean,qualified:string>"
    found = "struct<at:int,first:int,last:int,name:string,qualified:string>"
    closed = "transform(filter(a.stack, e -> {test}e.ok), e -> named_struct('at', e.at, 'first', e.first, 'last', a.prev, 'name', e.name, 'qualified', e.qualified))"
    fold = F.expr(f"""
        aggregate(__rows, named_struct('stack', cast(array() as array<{entry}>), 'done', cast(array() as array<{found}>), 'prev', 0, 'plain', 0),
          (a, r) -> if(r.closes, named_struct('stack', a.stack, 'done', a.done, 'prev', r.at, 'plain', r.at),
            named_struct(
              'stack', array_append(filter(a.stack, e -> e.indent < r.indent), named_struct('indent', r.indent, 'name', r.name, 'at', r.at, 'first', a.plain + 1,
                 'ok', r.name is not null and forall(a.stack, e -> e.indent >= r.indent or e.name is not null),
                 'qualified', concat_ws('.', transform(filter(a.stack, e -> e.indent < r.indent), e -> e.name), r.name))),
              'done', concat(a.done, {closed.format(test="e.indent >= r.indent and ")}),
              'prev', r.at, 'plain', if(r.decorates, a.plain, r.at))),
          a -> array_sort(concat(a.done, {closed.format(test="")})))""")
    f = f.select(*keep, "__lines", fold.alias("__defs"))

    def finish(d: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(F.array_join(F.slice("__lines", d["first"], d["last"] - d["first"] + 1), "\n"), STRINGS, "\"\""), r"#[^\n]*", "")
        plain = F.regexp_replace(plain, r"\b(def|class)[ \t]+\w+", "$1")
        calls = F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(plain, F.lit(CALL), F.lit(1))), F.array(*map(F.lit, PYTHON_WORDS))))
        return F.struct(d["name"].alias("name"), d["qualified"].alias("qualified_name"), d["at"].alias("start_line"), d["last"].alias("end_line"), calls.alias("calls"))

    # the lines are looked at once for each definition, so they stand in a column that is used twice
    f = f.select(*keep, F.when(F.size("__lines") > 0, F.transform("__defs", finish)).alias("blocks"))
    return f.withColumn("blocks", F.coalesce("blocks", F.array().cast("array<struct<name:string,qualified_name:string,start_line:int,end_line:int,calls:array<string>>>")))


def with_parsed(files: DataFrame, keep: list[str], content: str, language: Column) -> DataFrame:
    """``keep`` and ``symbols``, an array of name, qualified_name, start_line, end_line, calls: of Python by its blocks, of
    other languages, and of Python texts without any block, by the forms of lines."""
    f = files.withColumn("__python", F.when(language == "python", F.col(content)))
    f = with_blocks(f, [*keep, content], "__python")
    f = f.withColumn("__other", F.when(F.size("blocks") == 0, F.col(content)))
    f = with_symbols(f, [*keep, "blocks"], "__other")
    plain = F.transform("symbols", lambda s: F.struct(s["name"].alias("name"), s["name"].alias("qualified_name"), s["start_line"].alias("start_line"), s["end_line"].alias("end_line"), s["calls"].alias("calls")))
    return f.select(*keep, F.when(F.size("blocks") > 0, F.col("blocks")).otherwise(plain).alias("symbols"))


def normal_dependency(c: Column) -> Column:
    """The short name by which an import is looked up: no leading dots, last path part, no source suffix."""
    t = F.trim(c)
    t = F.when(t.startswith("."), F.regexp_replace(t, r"^[./]+", "")).otherwise(t)
    t = F.element_at(F.split(t, "/"), -1)
    for s in (".py", ".js", ".ts"):
        t = F.regexp_replace(t, s.replace(".", r"\.") + "$", "")
    return t


def specifiers(content: Column, language: Column) -> Column:
    """The imports of a text, each once, as an array.

    Python: the first part of imported modules and the module of a from-import, line by line. Other languages: the
    quoted text of from, import and require.
    """
    plain = F.transform(F.flatten(F.transform(F.regexp_extract_all(content, F.lit(PYTHON_IMPORT), F.lit(1)), lambda x: F.split(x, ","))), lambda x: F.element_at(F.split(F.trim(x), r"\."), 1))
    python = F.concat(plain, F.regexp_extract_all(content, F.lit(PYTHON_FROM), F.lit(1)))
    quoted = F.concat(*(F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in QUOTED_IMPORTS))
    return F.filter(F.array_distinct(F.when(language == "python", python).otherwise(quoted)), lambda x: x != "")


def script_bindings(content: Column) -> Column:
    """The names that imports of a JavaScript or TypeScript text bind, as an array of local_name, imported_name, specifier.

    ``default`` is what a bare name stands for, ``*`` a whole module. Both import clauses and require are read; a renamed
    name has its own name on the other side.
    """

    def statements(form: str) -> Column:
        part = lambda n: F.regexp_extract_all(content, F.lit(form), F.lit(n))
        return F.zip_with(part(1), part(2), lambda c, m: F.struct(c.alias("clause"), m.alias("specifier")))

    def bound(local: Column, imported: Column, specifier: Column) -> Column:
        return F.struct(local.alias("local_name"), imported.alias("imported_name"), specifier.alias("specifier"))

    def one(form: str, whole: str, renamed: str):
        def read(s: Column) -> Column:
            clause, m = s["clause"], s["specifier"]
            bare = F.regexp_extract_all(clause, F.lit(BARE_NAME), F.lit(1))
            star = F.regexp_extract_all(clause, F.lit(STAR_NAME), F.lit(1))
            named = F.filter(F.transform(F.split(F.regexp_extract(clause, r"\{([^}]*)\}", 1), ","), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: F.rlike(x, F.lit(renamed)))
            names = F.transform(named, lambda x: bound(F.coalesce(F.nullif(F.regexp_extract(x, renamed, 2), F.lit("")), F.regexp_extract(x, renamed, 1)), F.regexp_extract(x, renamed, 1), m))
            return F.concat(F.transform(bare, lambda x: bound(x, F.lit(whole), m)), F.transform(star, lambda x: bound(x, F.lit("*"), m)), names)

        return F.flatten(F.transform(statements(form), read))

    return F.array_distinct(F.concat(one(IMPORT_CLAUSE, "default", IMPORT_RENAMED), one(REQUIRE_CLAUSE, "*", REQUIRE_RENAMED)))


def text_dependencies(files: DataFrame, key: str, content: str, language: Column) -> DataFrame:
    """``key, specifier, dependency`` of each import of a text, as :func:`specifiers` finds them."""
    each = rows_of(files, [key], F.transform(specifiers(F.col(content), language), lambda x: F.struct(x.alias("specifier"))), "specifier")
    return each.withColumn("dependency", normal_dependency(F.col("specifier")))


def _python_rows(content: str) -> tuple[list[tuple[str, str, str, int, int, list[str]]], list[tuple[str, str | None, str]]]:
    """Symbols (name, qualified name, kind, lines, calls) and import bindings (local, imported, module) of one text."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [], []
    symbols: list[tuple[str, str, str, int, int, list[str]]] = []
    bindings: list[tuple[str, str | None, str]] = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            bindings += [(a.asname or a.name.split(".")[0], None, a.name) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            bindings += [(a.asname or a.name, a.name, module) for a in node.names]
    stack: list[tuple[list[ast.stmt], str]] = [(tree.body, "")]
    while stack:
        body, prefix = stack.pop()
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                qualified = f"{prefix}{node.name}"
                calls = {c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute))}
                symbols.append((node.name, qualified, "class" if isinstance(node, ast.ClassDef) else "function", node.lineno, node.end_lineno or node.lineno, sorted(calls)))
                stack.append((node.body, qualified + "."))
    return symbols, bindings


def python_symbols(files: DataFrame, key: str, content: str) -> DataFrame:
    """Definitions of Python texts by their syntax tree: those reachable through class and function bodies only.

    A text that does not parse, or is null, has none.
    """
    cols = files.selectExpr(f"`{key}` as row_id", f"`{content}` as content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for i, t in zip(b.column("row_id").to_pylist(), b.column("content").to_pylist()):
                for row in _python_rows(t or "")[0]:
                    for col, v in zip(out, (i, *row)):
                        col.append(v)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["row_id", "name", "qualified_name", "kind", "start_line", "end_line", "calls"])

    return cols.mapInArrow(run, "row_id bigint, name string, qualified_name string, kind string, start_line int, end_line int, calls array<string>")


def python_imports(files: DataFrame, key: str, content: str) -> DataFrame:
    """Local names bound by imports of Python texts, with the imported name (null for a whole module) and the module."""
    cols = files.selectExpr(f"`{key}` as row_id", f"`{content}` as content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for i, t in zip(b.column("row_id").to_pylist(), b.column("content").to_pylist()):
                for row in _python_rows(t or "")[1]:
                    for col, v in zip(out, (i, *row)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.string()) for c in out[1:])], ["row_id", "local_name", "imported_name", "module"])

    return cols.mapInArrow(run, "row_id bigint, local_name string, imported_name string, module string")


def python_functions(files: DataFrame, key: str, content: str) -> DataFrame:
    """Every function of Python texts, nested and conditional ones included, with the names it calls."""
    cols = files.selectExpr(f"`{key}` as row_id", f"`{content}` as content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for i, t in zip(b.column("row_id").to_pylist(), b.column("content").to_pylist()):
                try:
                    nodes = [n for n in ast.walk(ast.parse(t or "")) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                for n in nodes:
                    calls = {c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(n) if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute))}
                    for col, v in zip(out, (i, n.name, n.lineno, sorted(calls))):
                        col.append(v)
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["row_id", "name", "start_line", "calls"])

    return cols.mapInArrow(run, "row_id bigint, name string, start_line int, calls array<string>")
