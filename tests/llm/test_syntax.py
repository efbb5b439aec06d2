import glob
import json
import os
import random
import sys

import pytest

from hunkyard.llm.python_stack import python_problem
from hunkyard.llm.syntax import _json_walk, flag, language, problem, verdict

GOOD = {
    "javascript": [
        "const f = async (a = 0, {b, c: [d]}, ...e) => { for await (const x of a) yield_(x); return b ?? d };\nexport default f",
        "label: for (let i = 0, n = 3; i < n; i += 1) { if (i) continue label; else break }",
        "class A extends B { static #p = 1; get x() { return this.#p } async *g() { yield* h() } static { f() } constructor() { super() } }",
        "const s = `a${`b${c}`}`; const r = /[/\\]]+(x|y)\\/g/gi.test(s) ? a / b / c : {a, 'b': 1, [c]: 2, get d() { return 1 }}",
        "var a = 1\nvar b = 2\n;({a, b} = c)\n[x, y] = [y, x]\nif (a) b\nelse c\ndo x(); while (0) z()",
        "import a, * as b from 'x'; import {default as c, d} from \"y\"; export * from 'z'; export {c as e}",
        "x = a ? b : c ? d : (e, f); y = !function () {}(); z = new Foo(1)?.bar?.[2]?.(3) ** 2; delete a.b, void 0",
        "switch (a) { case 1: case 2: f(); break; default: g() } try { x() } catch { y() } finally { z() }",
        "#!/usr/bin/env node\nlet async; async = 1; const of = 2, get = 3; let x = 1_000n, y = .5e-3, z = 0xFF;",
        "",
    ],
    "typescript": [
        "export abstract class A<T extends B = C> implements D, E<F[]> { private readonly x?: Map<string, Array<number>>; constructor(public a: string, b?: number) { super() } abstract f(): void; static g<U>(u: U): u is U { return true } [k: string]: any }",
        "type M<T> = { readonly [K in keyof T]?: T[K] extends (infer U)[] ? U : never }; type F = (a: number, ...b: string[]) => void; type L = `a${string}`; declare const q: unique symbol;",
        "const f = <T,>(x: T): T => x; const g = async (a?: string): Promise<void> => {}; const h = a ? (b) : c => d; let i = x as unknown as string[]; let j = <any>k; l!.m!();",
        "enum Color { Red = 1, Green = 'g' } namespace N.M { export const x = 1 } interface I extends J<K> { (x: number): string; new (y: string): I; z?(): void; readonly w: typeof import('x') }",
        "import type { A } from './a'; export type { B } from './b'; import fs = require('fs'); function f(this: Window, x: number | null): asserts x is number; function f(x: any) {}",
        "if (a < b && c > d) { e = f<G>(h) } const z = a as const; let t: [a: string, b?: number, ...c: boolean[]]; x = y >> 2 >>> 1; x >>= 1",
    ],
    "python": ["x = f\"{a['b']}\"\nprint(x)\n", "match x:\n    case [1, *_]: pass\n", "", "\ufeffx = 1\n"],
    "json": ['{"a": [1, 2.5e-3, null, true, "\\u00e9"]}', " 1 ", '"x"'],
}
BAD = {
    "javascript": ["const = 5;", "a => => b;", "return 1;", "let y = 3 +;", "foo(1,, 2);", "if x > 3: y", "const {a, b = obj;", "function (", "let s = 'abc\n'", "x = 3px", "{a: 1}}", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x", "const a;", "function f(a: string) {}", "var x = `a${b`", "/* never", "class { }", "({a = 1})", "1 = 2", "import {if} from 'x'", "const r = /(/;", "a ?? b || c", "} else {", "for (;;", "x = 'a' 'b'"],
    "typescript": ["interface A { x: }", "type A = ;", "enum { A }", "const x: = 3", "def f(): pass", '{"a": 1, "b": 2}', "function f(a: string, { }", "let x: Array<string = 1"],
    "python": ["def f(:\n  pass", "print 'x'", "x = 'abc", "if a:\npass", "<<<<<<< HEAD\nx = 1\n", "x = 1\x00"],
    "json": ["", " ", "{'a': 1}", '{"a": 1,}', "[1 2]", "NaN", "[01]", '{"a": 1} x', '"a\nb"', "// c\n1", '{"a" 1}', "\ufeff1"],
}


@pytest.mark.parametrize("lang", list(GOOD))
def test_texts_that_parse_and_that_do_not(lang):
    assert [t for t in GOOD[lang] if problem(t, lang)] == []
    assert [t for t in BAD[lang] if not problem(t, lang)] == []


def test_remembered_shapes_change_no_verdict():
    texts = GOOD["javascript"] + BAD["javascript"]
    assert [problem(t, "javascript") for t in texts] == [problem(t, "javascript") for t in texts]


def test_json_walk_agrees_with_the_c_parser():
    r = random.Random(1)
    for _ in range(3000):
        s = "".join(r.choice(['"a"', "1", "[", "]", "{", "}", ":", ",", " ", "true", "-", "0.5"]) for _ in range(r.randrange(1, 9)))
        try:
            json.loads(s)
            want = True
        except ValueError:
            want = False
        assert _json_walk(s) == want, s
    assert problem("[" * 200_000 + "]" * 200_000, "json") is None and problem("[" * 200_000, "json") == "premature end"


def test_names_and_reasons():
    assert language(" PYTHON ", "a.js") == "python" and language(None, "x/a.TS") == "typescript" and language("cobol", "a.py") is None and language(None, None) is None
    assert problem("x = (1", "python") == "premature end" and problem("x = 'a", "python") == "unterminated literal" and problem("x = 1)", "python") == "unbalanced delimiter"
    assert problem("    x = 1\n    y = 2\n", "python", True) is None and problem("    x = 1\n    y = 2\n", "python") == "unexpected indent"
    assert problem(None, "json") is None and problem("", "python") is None and problem("(" * 5000 + ")" * 5000, "javascript")


def test_table(spark):
    df = spark.createDataFrame([(1, "r", "x = (", "a.py", "Py", "z"), (1, "r", "x = (", "a.py", "Py", "z"), (2, None, None, "a.py", None, "z"), (3, "r", "", "a.json", None, "z"), (4, "r", "let x = 1;\n" * 30_000, "a.ts", None, "z")], "id bigint, repo string, t string, p string, l string, reason string")
    got = sorted((r.row_id, r.language, r.reason) for r in flag(df, "id", "t", "p", "l", "content", "repo", True).collect())
    assert got == [(1, "python", "premature end"), (1, "python", "premature end"), (3, "json", "premature end")]
    assert flag(df, "id", "t", "p", "l", "content", "repo").count() == 4
    assert flag(df.limit(0), "id", "t", "p", "l", "content", "repo").count() == 0


def test_limits_of_the_parsers_are_no_errors():
    chain = "if a:\n    b\n" + "elif a:\n    b\n" * 6000
    calls = "x = a" + ".f()" * 6000 + "\n"
    for t in (chain, calls, "@d\ndef f():\n    pass\n\n" + chain + "else:\n    c\n" + calls):
        assert problem(t, "python") is None
        assert problem(t + "y = 3 +\n", "python") == "missing operand" and problem(t + "y = (3\n", "python") == "premature end" and problem("def f(:\n  pass\n" + t, "python")
        assert problem(t + "if a:\n    b\n  c\n", "python")
    deep = "x = " + "[" * 9000 + "]" * 9000
    usual = sys.getrecursionlimit()
    assert problem(deep, "javascript") is None and problem(deep, "typescript") is None
    assert problem(deep + "; y = 3 +;", "javascript") == "syntax" and problem(deep[:-1], "javascript")
    assert problem("x = " + "[" * 9000 + "1 2" + "]" * 9000, "javascript") == "syntax"
    assert sys.getrecursionlimit() == usual


def test_stacks_of_python_agree_with_its_parser():
    for t in GOOD["python"] + BAD["python"]:
        assert bool(python_problem(t.removeprefix("\ufeff"))) == bool(problem(t, "python")), t
    files = sorted(glob.glob(os.path.dirname(os.__file__) + "/*.py"))
    wrong = [f for f in files if verdict(open(f, encoding="utf-8", errors="replace").read(), "python")[1]]
    assert len(wrong) <= 0.02 * len(files), wrong
    r = random.Random(5)
    seen = {"stack": 0, "exact check": 0, "overruled": 0, None: 0}
    for f in files[:60]:
        words = open(f, encoding="utf-8", errors="replace").read()[:4000].split(" ")
        for _ in range(4):
            at = r.randrange(len(words))
            seen[verdict(" ".join(words[:at] + words[at + 1 :]), "python")[1]] += 1
    assert seen["stack"] > 100 and seen["exact check"] <= 0.1 * seen["stack"] and seen["overruled"] <= 0.02 * seen["stack"], seen


def test_forms_of_newer_and_older_scripts():
    for t in ["using x = f();", "{ await using y = g(), z = h(); }", "for (using x of y) { x() }", "let using = 1; using = 2; using(x)"]:
        assert problem(t, "typescript") is None, t
    assert problem("<!-- old\nf();\n--> end\n", "javascript") is None and problem("using x;", "typescript")
    assert problem("<!-- old\nimport a from 'a';\n", "javascript") and problem("<!-- old\nf(;\n", "javascript")
