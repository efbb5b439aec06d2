import random

from pyspark.sql import functions as F

from hunkyard.operators import graph as G
from hunkyard.operators import symbols as S

FILES = "src_id bigint, repo string, git_ref string, path string, content string, name string"


def files(spark, data):
    return spark.createDataFrame([(i, "r", "x", p, c, "clash") for i, (p, c) in enumerate(data.items())], FILES)


def symbols(f):
    s = S.text_symbols(f.select("src_id", "content"), "src_id", "content").join(f.drop("content", "name"), "src_id")
    return s.withColumn("id", G.symbol_id(F.col("path"), F.col("name"), F.col("start_line")))


def test_text_symbols(spark):
    f = files(spark, {"a.py": "import os\n\ndef f(x):\n    return g(x) + f(x)\n\nclass C:\n    pass\n\n", "b.js": "export async function h(a) {\n  f (a); C()\n}\nconst k = async (x) => h(x)\n", "n.py": None, "e.py": ""})
    got = {(r.path, r.name, r.start_line, r.end_line, tuple(r.calls)) for r in symbols(f).collect()}
    assert got == {("a.py", "f", 3, 5, ("g",)), ("a.py", "C", 6, 8, ()), ("b.js", "h", 1, 3, ("C", "f")), ("b.js", "k", 4, 4, ("async", "h"))}
    assert symbols(f.limit(0)).count() == 0


def test_dependencies(spark):
    f = files(spark, {"a.py": "import os.path, re\nfrom x.y import z\n  from .up import q\n", "b.ts": "import a from './lib/a.ts';\nimport \"side\";\nconst c = require('../c.js'); export * from '@/d';", "n.ts": None})
    got = {(r.src_id, r.specifier, r.dependency) for r in S.text_dependencies(f, "src_id", "content", F.when(F.col("path").endswith(".py"), "python").otherwise("typescript")).collect()}
    assert got == {(0, "os", "os"), (0, "re", "re"), (0, "x.y", "x.y"), (0, ".up", "up"), (1, "./lib/a.ts", "a"), (1, "side", "side"), (1, "../c.js", "c"), (1, "@/d", "d")}


def test_python_syntax_trees(spark):
    f = files(spark, {"a.py": "import os as o\nfrom x import y as z\nclass A:\n    def m(self):\n        return self.n(f())\nif True:\n    def hidden(): pass\n", "bad.py": "def (", "n.py": None})
    got = {(r.row_id, r.qualified_name, r.kind, r.start_line, r.end_line, tuple(r.calls)) for r in S.python_symbols(f, "src_id", "content").collect()}
    assert got == {(0, "A", "class", 3, 5, ("f", "n")), (0, "A.m", "function", 4, 5, ("f", "n"))}
    assert {tuple(r) for r in S.python_imports(f, "src_id", "content").collect()} == {(0, "o", None, "os"), (0, "z", "y", "x")}


def test_import_resolution(spark):
    f = files(spark, {"src/app.js": "", "src/lib/index.js": "", "src/math.ts": "", "src/services/calc.ts": "", "root.ts": "", "pkg/deep/x.tsx": ""})
    imports = spark.createDataFrame([("r", "x", "src/app.js", "./lib"), ("r", "x", "src/services/calc.ts", "../math"), ("r", "x", "src/services/calc.ts", "@/pkg/deep/x"), ("r", "x", "src/app.js", "react"), ("r", "x", "src/app.js", "./../root.ts"), ("r", "y", "src/app.js", "./lib")], "repo string, git_ref string, path string, specifier string")
    got = {(r.git_ref, r.path, r.specifier, r.target) for r in G.resolve_imports(imports, f).collect()}
    assert got == {("x", "src/app.js", "./lib", "src/lib/index.js"), ("x", "src/services/calc.ts", "../math", "src/math.ts"), ("x", "src/services/calc.ts", "@/pkg/deep/x", "pkg/deep/x.tsx"), ("x", "src/app.js", "./../root.ts", "root.ts")}


def test_callers_dependents_context_and_risk(spark):
    f = files(spark, {
        "auth/token.py": "def validate_token(t):\n    return t\n",
        "service.py": "from auth.token import validate_token\ndef login(u):\n    return validate_token(u)\n",
        "tests/test_service.py": "from service import login\ndef test_login():\n    assert login(1)\n",
    })
    s = symbols(f)
    e = G.caller_edges(s)
    assert {(r.callee_id, r.caller_id) for r in e.collect()} == {("auth/token.py:validate_token:1", "service.py:login:2"), ("service.py:login:2", "tests/test_service.py:test_login:2")}
    two = {(r.symbol_id, r.caller_id, r.depth) for r in G.callers_within_two(e).collect()}
    assert ("auth/token.py:validate_token:1", "tests/test_service.py:test_login:2", 2) in two and len(two) == 3
    deps = S.text_dependencies(f, "src_id", "content", F.lit("python")).join(f.drop("content", "name"), "src_id")
    d = G.dependents(deps, f)
    assert {(r.path, r.dependent) for r in d.collect()} == {("auth/token.py", "service.py"), ("service.py", "tests/test_service.py")}
    ctx = [(r.symbol_id, r.score) for r in G.related_symbols(s, e, d).where("path = 'auth/token.py'").orderBy("rank").collect()]
    assert ctx == [("service.py:login:2", 100), ("tests/test_service.py:test_login:2", 70)]
    score, level, reasons = G.risk(F.lit(1), F.lit(1), F.lit(1), F.lit(1), F.lit("auth/token.py"))
    r = spark.range(1).select(score, level, reasons).first()
    assert tuple(r) == (49, "medium", "1 changed symbol(s); 1 direct caller(s); 1 transitive caller(s); 1 importing/dependent file(s); sensitive path: auth, token")
    r = spark.range(1).select(*G.risk(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit("x"))[:2]).first()
    assert tuple(r) == (25, "low")
    r = spark.range(1).select(*G.risk(F.lit(9), F.lit(9), F.lit(9), F.lit(9), F.lit("sql"))[:2]).first()
    assert tuple(r) == (100, "critical")


def test_seed_met_again_through_a_circle(spark):
    e = spark.createDataFrame([("r", "x", "a", "b"), ("r", "x", "b", "a"), ("r", "x", "b", "c")], "repo string, git_ref string, callee_id string, caller_id string")
    got = {(r.symbol_id, r.caller_id, r.depth) for r in G.callers_within_two(e).collect()}
    assert got == {("a", "b", 1), ("b", "a", 1), ("b", "c", 1), ("a", "a", 2), ("a", "c", 2), ("b", "b", 2)}


def test_imported_callers(spark):
    f = files(spark, {"m.ts": "export function add(a) {}\nfunction sub(a) {}\n", "u.ts": "import { add as sum } from './m';\nfunction go() {\n  sum(1); all(2);\n}\n"})
    s = symbols(f)
    b = spark.createDataFrame([("r", "x", "u.ts", "sum", "add", "./m"), ("r", "x", "u.ts", "all", "*", "./m")], "repo string, git_ref string, path string, local_name string, imported_name string, specifier string")
    t = G.resolve_imports(b.select(*G.NS, "path", "specifier"), f)
    assert {r.callee_id for r in G.imported_callers(s, b.where("local_name = 'sum'"), t).collect()} == {"m.ts:add:1"}
    assert {r.callee_id for r in G.imported_callers(s, b.where("local_name = 'all'"), t).collect()} == {"m.ts:add:1", "m.ts:sub:2"}


BLOCKS = '''"""Module."""
import os


@cached(1)
def outer(a,
          b=dict(x=1)):
    """It says "def no(): pass".

    class Neither:
    """
    # call(this)
    def inner():
        return deep("gone(1)")

    if a:
        def hidden():
            lost()
    return inner() and not (a)


class Shape:
    async def area(self):
        return await compute(
            self.x,
        )

    class Part:
        pass
x = done()
'''


def test_blocks_agree_with_the_syntax_tree(spark):
    import ast
    import glob
    import os

    def tree(text):
        out, stack = set(), [(ast.parse(text).body, "")]
        while stack:
            body, prefix = stack.pop()
            for n in body:
                if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    calls = {c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(n) if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute))}
                    out.add((prefix + n.name, n.lineno, n.end_lineno, tuple(sorted(calls))))
                    stack.append((n.body, f"{prefix}{n.name}."))
        return out

    texts = [BLOCKS] + [open(f, encoding="utf-8").read() for f in sorted(glob.glob(os.path.dirname(os.__file__) + "/[a-d]*.py"))[:12]]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(-1, None, "x"), (-2, "", "x"), (-3, "x = 1\n", "x")], "id int, content string, name string")
    got = {r.id: {(b.qualified_name, b.start_line, b.end_line, tuple(b.calls)) for b in r.blocks} for r in S.with_blocks(df, ["id"], "content").collect()}
    assert got[-1] == got[-2] == got[-3] == set() and got[0] == tree(BLOCKS)
    names = [({x[:2] for x in got[i]}, {x[:2] for x in tree(t)}) for i, t in enumerate(texts)]
    assert sum(a == b for a, b in names) >= len(names) - 1  # three quotes inside a string of one quote lead astray


def test_symbols_by_language(spark):
    df = spark.createDataFrame([(1, "python", "class A:\n    def f(self):\n        g()\n"), (2, "javascript", "function f() {\n  g();\n}\n"), (3, "python", "if x:\n    def f():\n        g()\n"), (4, None, "def f(): g()\n"), (5, "python", None)], "id int, lang string, content string")
    got = {r.id: [(s.qualified_name, s.start_line, s.end_line, s.calls) for s in r.symbols] for r in S.with_parsed(df, ["id"], "content", F.coalesce("lang", F.lit(""))).collect()}
    assert got == {1: [("A", 1, 3, ["g"]), ("A.f", 2, 3, ["g"])], 2: [("f", 1, 3, ["g"])], 3: [("f", 2, 3, ["g"])], 4: [("f", 1, 1, ["g"])], 5: []}


def test_bindings_of_scripts(spark):
    text = "import type { A } from './a';\nimport D, { x as y, z } from \"./b\"\nimport * as ns from 'c';\nconst { p, q: r } = require('./d');\nlet whole = require('e');\nimport 'f';\n// import no from 'g'\nimport {\n  one,\n  two as zwei,\n} from './h';\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, content string")
    got = {tuple(b) for r in df.select("id", S.script_bindings(F.col("content")).alias("b")).collect() for b in (r.b or [])}
    assert got == {("A", "A", "./a"), ("D", "default", "./b"), ("y", "x", "./b"), ("z", "z", "./b"), ("ns", "*", "c"), ("p", "p", "./d"), ("r", "q", "./d"), ("whole", "*", "e"), ("one", "one", "./h"), ("zwei", "two", "./h")}


def test_default_takes_top_level_symbols_and_names_may_be_qualified(spark):
    cols = "repo string, git_ref string, path string, id string, name string, qualified_name string, calls array<string>"
    s = spark.createDataFrame([("r", "x", "m.ts", "m:Top", "Top", "Top", []), ("r", "x", "m.ts", "m:Top.go", "go", "Top.go", []), ("r", "x", "n.ts", "n:In.a", "a", "In.a", []), ("r", "x", "u.ts", "u:f", "f", "f", ["D", "E", "g"])], cols)
    b = spark.createDataFrame([("r", "x", "u.ts", "D", "default", "./m"), ("r", "x", "u.ts", "E", "default", "./n"), ("r", "x", "u.ts", "g", "Top.go", "./m")], "repo string, git_ref string, path string, local_name string, imported_name string, specifier string")
    t = spark.createDataFrame([("r", "x", "u.ts", "./m", "m.ts"), ("r", "x", "u.ts", "./n", "n.ts")], "repo string, git_ref string, path string, specifier string, target string")
    say = lambda name: {r.callee_id for r in G.imported_callers(s, b.where(F.col("local_name") == name), t).collect()}
    assert say("D") == {"m:Top"} and say("E") == {"n:In.a"} and say("g") == set()
    b2 = b.withColumn("imported_name", F.lit("go"))
    assert {r.callee_id for r in G.imported_callers(s, b2.where("local_name = 'g'"), t).collect()} == {"m:Top.go"}


def test_importers_stand_in_where_no_file_is_found(spark):
    deps = spark.createDataFrame([("r", "x", "a.ts", "lib/core", "core"), ("r", "x", "b.ts", "core", "core"), ("r", "x", "c.ts", "./m", "m")], "repo string, git_ref string, path string, specifier string, dependency string")
    found = spark.createDataFrame([("r", "x", "c.ts", "./m", "m.ts")], "repo string, git_ref string, path string, specifier string, target string")
    got = {(x.path, x.target) for x in G.targets_or_importers(found, deps, deps).collect()}
    assert got == {("c.ts", "m.ts"), ("a.ts", "a.ts"), ("a.ts", "b.ts"), ("b.ts", "a.ts"), ("b.ts", "b.ts")}
    assert G.targets_or_importers(found.limit(0), deps.limit(0), deps).count() == 0


def test_paths(spark):
    df = spark.createDataFrame([("a/./b/../c//d",), ("../x",), ("",)], "p string")
    assert [r[0] for r in df.select(G.normal_path(F.col("p"))).collect()] == ["a/c/d", "x", ""]
    df = spark.createDataFrame([("lib/index.ts",), ("a/b.py",)], "p string")
    assert [set(r[0]) for r in df.select(G.path_keys(F.col("p"))).collect()] == [{"lib/index.ts", "lib/index", "index", "lib.index", "lib"}, {"a/b.py", "a/b", "b", "a.b"}]


def test_callers_against_brute_force(spark):
    r = random.Random(3)
    e = {(f"s{r.randrange(8)}", f"s{r.randrange(8)}") for _ in range(20)}
    e = {(a, b) for a, b in e if a != b}
    df = spark.createDataFrame([("r", "x", a, b) for a, b in e], "repo string, git_ref string, callee_id string, caller_id string")
    got = {(x.symbol_id, x.caller_id, x.depth) for x in G.callers_within_two(df).collect()}
    one = {(a, b, 1) for a, b in e}
    two = {(a, c, 2) for a, b in e for b2, c in e if b == b2 and (a, c) not in e}
    assert got == one | two


def test_aliases_of_the_deepest_config(spark):
    f = files(spark, {
        "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "exact": ["src/one.ts"]}}}',
        "app/tsconfig.json": '// c\n{"compilerOptions": {"baseUrl": "./lib", /* x */ "paths": {"~/*/end": ["deep/*"]}}}',
        "bad/jsconfig.json": "{", "src/math.ts": "", "src/one.ts": "", "app/lib/deep/x.tsx": "", "app/lib/util.js": "", "src/u.ts": "", "app/v.ts": "",
    })
    imports = spark.createDataFrame([("r", "x", p, s) for p, s in [("src/u.ts", "@/math"), ("src/u.ts", "exact"), ("app/v.ts", "~/x/end"), ("app/v.ts", "util"), ("app/v.ts", "@/lib/none"), ("src/u.ts", "./one")]], "repo string, git_ref string, path string, specifier string")
    got = {(r.path, r.specifier, r.target) for r in G.resolve_imports(imports, f, G.module_configs(f)).collect()}
    assert got == {("src/u.ts", "@/math", "src/math.ts"), ("src/u.ts", "exact", "src/one.ts"), ("app/v.ts", "~/x/end", "app/lib/deep/x.tsx"), ("app/v.ts", "util", "app/lib/util.js"), ("src/u.ts", "./one", "src/one.ts")}


def test_repo_map_and_test_targets(spark):
    f = files(spark, {"a.py": "def f():\n    def g():\n        h()\n    g()\nif 1:\n    def h(): pass\n", "b.py": "def f():\n    h()\n", "bad.py": "def ("})
    m = {r.name: (r.path, r.start_line, r.n_callers, r.callers) for r in G.repo_map(S.python_functions(f, "src_id", "content").withColumnRenamed("row_id", "src_id").join(f.drop("content", "name"), "src_id")).collect()}
    assert m == {"f": ("b.py", 1, 0, "no known callers"), "g": ("a.py", 2, 0, "no known callers"), "h": ("a.py", 6, 2, "`f` (b.py:1), `g` (a.py:2)")}
    p = spark.createDataFrame([("r", "x", p) for p in ["src/login.py", "src/x.py", "t/test_login.py", "t/test_.py", "src/my_test_.py"]], "repo string, git_ref string, path string")
    is_test = F.rlike("path", F.lit("/test_[^/]*$"))
    got = {(r.path, r.test_path) for r in G.test_targets(p.where(~is_test), p.where(is_test)).collect()}
    assert got == {("src/login.py", "t/test_login.py"), ("src/x.py", None), ("src/my_test_.py", "t/test_.py")}
