import random
import re

from pyspark.sql import functions as F

from hunkyard.functions import text as T
from hunkyard.operators import diff as D

FILES = "diff_id bigint, file_path string, language string, status string, patch string, full_content string, max_tokens int, k string"


def rows(spark, data):
    return spark.createDataFrame([(i, p, lang, s, patch, full, m, "clash") for i, (p, lang, s, patch, full, m) in enumerate(data)], FILES)


def one(spark, patch, full="", path="a.py", status="modified", m=6000, lang="python"):
    return rows(spark, [(path, lang, status, patch, full, m)])


def count(t):
    return len(re.findall(r"\w+|[^\s\w]", t or ""))


def test_tokens_lines_and_languages(spark):
    texts = [None, "", "a_b 1 + x.y()", "größe naïve 变量 é ½ ²", "tab\tnl\x0b\x1c\x85 x y", "🎉 👩‍👩"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.tokens(F.col("t"))).collect()] == [count(t) for t in texts]
    lines = ["a\r\nb\rc\n\nd", "", None, "x\n", "\n", "a\x0bb\x0cc\x1cd\x85e f"]
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    assert [r[0] for r in df.select(T.lines(F.col("t"))).collect()] == [(t or "").splitlines() for t in lines]
    df = spark.createDataFrame([("a/B.PY",), ("Makefile",), ("x.tsx",), ("dist/a.js",), ("a.d.ts",), (".py",)], "p string")
    assert [tuple(r) for r in df.select(T.provider_language(F.col("p")), T.index_language(F.col("p"))).collect()] == [("python", "python"), ("unknown", None), ("typescript", "typescript"), ("javascript", None), ("typescript", "typescript"), ("python", None)]


def test_skip_reasons_first_one_wins(spark):
    df = rows(spark, [
        ("package-lock.json", "json", "removed", "@@ -1 +1 @@\n+a", "", 0),
        ("a.py", "python", "removed", "", "", 0),
        ("a.py", "python", "added", " \n", "", 0),
        ("a.py", "python", "added", None, "", 0),
        ("a.py", "python", "added", "no hunk\n+x", "", 0),
        ("a.py", "python", "added", "+x\n@@ -1 +0,0 @@\n-a", "", 0),
        ("a.py", "python", "added", "@@ -1 +1 @@\r\n-a\r\n+b", "", 0),
        ("src/build/a.py", "python", "added", "@@ -1 +1 @@\n+b", "", 0),
    ])
    got = [r[0] for r in df.orderBy("diff_id").select(D.skip_reason(F.col("file_path"), F.col("status"), F.col("patch"))).collect()]
    assert got == [r"ignored by pattern: package-lock\.json$", "removed file", "empty patch", "empty patch", "no parseable hunks", "no added or modified lines", None, r"ignored by pattern: (^|/)build/"]


def test_line_numbers_and_the_two_rules_for_added_lines(spark):
    patch = "junk\n@@ -9,3 +9,4 @@ def f\n a\n-b\n+++c\n+d\n\\ No newline\n---e\n+f\n@@ -30 +40 @@\n+g"
    df = one(spark, patch)
    n = [(r.hunk_no, r.kind, r.old_line, r.new_line) for r in D.numbered_lines(df).orderBy("pos").collect()]
    assert n == [(1, "@", None, None), (1, " ", 9, 9), (1, "-", 10, None), (1, "+", None, 10), (1, "+", None, 11), (1, "\\", None, None), (1, "-", 11, None), (1, "+", None, 12), (2, "@", None, None), (2, "+", None, 40)]
    assert sorted(r.new_line for r in D.added_line_numbers(df).collect()) == [11, 14, 40]
    h = D.hunks(df).orderBy("hunk_no").first()
    assert (h.old_start, h.old_count, h.new_start, h.new_count, h.n_lines, h.n_added, h.n_removed) == (9, 3, 9, 4, 7, 3, 2)
    assert df.select(T.added_text(F.col("patch"))).first()[0] == "d\nf\ng"
    for f in (D.numbered_lines, D.hunks, D.added_line_numbers, D.file_tokens, D.chunks):
        assert f(df.limit(0)).count() == 0


def render(path, lang, status, hunks, full):
    """A plain renderer, written from the description of what a review is shown."""
    out = [f"## File: {path}", f"Language: {lang}", f"Status: {status}", "", "Annotated unified diff:", "```diff"]
    for h in hunks:
        out += shown(h, full)
    return "\n".join([*out, "```", ""]).strip()


def shown(h, full):
    head, old, new, body = h
    out, changed = [head, "# columns: old_line new_line diff_line"], []
    for x in body:
        if x.startswith("\\"):
            out.append("   " + x)
        elif x.startswith("+"):
            out.append(f"{new:>11} +{x[1:]}")
            changed.append(new)
            new += 1
        elif x.startswith("-"):
            out.append(f"{old:>5} -{x[1:]}")
            old += 1
        else:
            out.append(f"{old:>5} {new:>5}  {x[1:] if x.startswith(' ') else x}")
            old, new = old + 1, new + 1
    lines = (full or "").splitlines()
    if lines and changed:
        out += ["", "# Extended new-file context around changed lines:"] * (max(min(changed) - 6, 1) <= min(max(changed) + 6, len(lines)))
        out += [f"{i}: {lines[i - 1]}" for i in range(max(min(changed) - 6, 1), min(max(changed) + 6, len(lines)) + 1)]
    return [*out, ""]


def pack(path, lang, status, hunks, full, budget):
    budget = max(budget, 256)
    out, cur = [], []
    for h in hunks:
        if cur and count(render(path, lang, status, [*cur, h], full)) > budget:
            out.append((count(render(path, lang, status, cur, full)), False))
            cur = []
        cur.append(h)
        if count(render(path, lang, status, [h], full)) > budget:
            cur = []
            part = []
            frame = count(render(path, lang, status, [], full))
            for x in shown(h, full):
                if part and frame + sum(map(count, part)) + count(x) > budget:
                    out.append((frame + sum(map(count, part)), True))
                    part = []
                part.append(x)
            out.append((frame + sum(map(count, part)), True))
    if cur:
        out.append((count(render(path, lang, status, cur, full)), False))
    return out


def test_tokens_and_chunks_against_a_plain_renderer(spark):
    r = random.Random(11)
    data, want = [], []
    for i in range(60):
        hunks, old, new = [], 1, 1
        for _ in range(r.randrange(1, 7)):
            body = [r.choice(["+", "-", " ", ""]) + " ".join(r.choice(["x = f(y)", "größe", "#", "a_b.c", ""]) for _ in range(r.choice([1, 3, 40]))) for _ in range(r.randrange(1, 12))] + ["+z"] + ["\\ No newline at end of file"] * (r.random() < 0.2)
            hunks.append((f"@@ -{old},{len(body)} +{new},{len(body)} @@ def f{old}", old, new, body))
            old, new = old + 50, new + 50
        full = "\n".join(r.choice(["a b c", "", "x(1)"]) for _ in range(r.choice([0, 3, 300])))
        budget = r.choice([0, 256, 300, 700])
        patch = "\n".join("\n".join([h[0], *h[3]]) for h in hunks)
        data.append((f"src/f{i}.py", "python", "modified", patch, full, budget))
        want.append((count(render(f"src/f{i}.py", "python", "modified", hunks, full)), pack(f"src/f{i}.py", "python", "modified", hunks, full, budget)))
    df = rows(spark, data)
    tokens = {x.diff_id: x.tokens for x in D.file_tokens(df).collect()}
    chunks = {}
    for x in D.chunks(df).orderBy("diff_id", "chunk_no").collect():
        chunks.setdefault(x.diff_id, []).append((x.token_count, x.compressed))
    for i, (t, c) in enumerate(want):
        assert tokens[i] == t, i
        assert chunks[i] == c, i
    assert any(comp for _, c in want for _, comp in c) and any(len(c) > 1 for _, c in want)


def test_slots_are_taken_in_order(spark):
    df = spark.createDataFrame([("r", 1, i, n, 5) for i, n in enumerate([2, 2, 3, 1])] + [("r", 2, 9000 + i, 1, 100) for i in range(9000, 9003)] + [(None, None, 1, 7, 3)], "repo string, pr int, ord bigint, n_chunks bigint, max_chunks bigint")
    got = {(r.repo, r.pr, r.ord): (r.kept_chunks, r.omitted) for r in D.cap_chunks(df, ["repo", "pr"], "ord").collect()}
    assert [got["r", 1, i] for i in range(4)] == [(2, False), (2, False), (1, True), (0, True)]
    assert got[None, None, 1] == (3, True) and len(got) == 8
