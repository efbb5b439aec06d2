import base64
import json

import pytest
from pyspark.sql import functions as F

from hunkyard.functions import budget as B
from hunkyard.functions import payloads as P
from hunkyard.operators.responses import first_valid, json_object, parse_responses
from hunkyard.sources.sinks import publish_plan, trace_files, upsert, write_json


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]


def test_budget(spark):
    w = spark.createDataFrame([(200_000,), (128_000,), (64_000,), (15_000,), (None,)], "w int")
    assert [r[0] for r in w.select(B.chunks_of_window(F.col("w"))).collect()] == [31, 19, 8, 4, 19]
    known = {"alpha-1": 200_000, "beta": 128_000, "beta-mini": 64_000}
    got = column(spark, ["ALPHA-1", "alpha-1-x", "beta-mini", "be", "my gamma", "other", "", None], lambda c: B.window_of_model(c, known, {"gamma": 32_000}))
    assert got == [200_000, 200_000, 64_000, 128_000, 32_000, 128_000, 128_000, 128_000]


def test_links_and_payloads(spark):
    links = ["https://github.com/o/r/pull/12", "o/r#7", "http://x", None, "https://github.com/o/r/pull/12/files"]
    assert column(spark, links, lambda c: P.pull_request(c)[0]) == ["o/r", "o/r", None, None, "o/r"]
    assert column(spark, links, lambda c: P.pull_request(c)[1]) == [12, 7, None, None, 12]
    assert column(spark, ['{"a": 1}', "no", None], lambda c: P.payload(c, F.lit("application/json"))) == ['{"a": 1}', None, None]
    assert column(spark, ["x=1&payload=%7B%22a%22%3A+1%7D", "y=2"], lambda c: P.payload(c, F.lit("application/x-www-form-urlencoded"))) == ['{"a": 1}', None]
    blob = base64.b64encode("größe".encode()).decode()
    assert column(spark, [blob, "!!", None], lambda c: P.blob_text(F.lit("a.py"), c, F.lit("base64"))) == ["größe", None, None]
    bad = base64.b64encode(b"a\xffb").decode()
    assert column(spark, [bad], lambda c: P.blob_text(F.lit("a.py"), c, F.lit("base64"))) == ["a�b"]
    assert column(spark, [blob], lambda c: P.blob_text(F.lit("a.bin"), c, F.lit("base64"))) == [None]
    assert column(spark, ['{/* x */"a": 1\n  // y\n}'], P.without_json_comments) == ['{"a": 1\n\n}']


def answer(*findings, **more):
    return json.dumps({"findings": list(findings), **more})


def test_responses(spark):
    rows = [
        ("good", 0, answer({"message": "m", "confidence": 0.7, "severity": "high", "line": 3, "fix": "f"}, {"message": "n", "confidence": 0.3})),
        ("defaults", 0, "Here:\n```json\n" + answer({"message": " m "}) + "\n```"),
        ("null", 0, answer({"message": "m", "confidence": None})),
        ("low", 0, answer({"message": "m", "confidence": 0.2})),
        ("bad one", 0, answer({"message": "m"}, {"message": " "})),
        ("odd severity", 0, answer({"message": "m", "severity": "fatal"})),
        ("out of range", 0, answer({"message": "m", "confidence": 1.5})),
        ("no list", 0, '{"findings": 3}'),
        ("empty", 0, "sure: {} done"),
        ("prose", 0, "nothing here"),
        ("void", 0, None),
        ("array", 0, "[1]"),
        ("stated", 0, answer({"message": "m", "severity": "medium"}, risk_level="critical")),
        ("retry", 0, "oops"), ("retry", 1, answer({"message": "second"})), ("retry", 2, answer({"message": "third"})),
        ("late", 0, "x"), ("late", 1, "x"), ("late", 2, "x"), ("late", 3, answer({"message": "too late"})),
    ]
    df = spark.createDataFrame([(k, n, "security", t, "clash") for k, n, t in rows], "k string, attempt int, agent string, text string, valid string")
    p = parse_responses(df, ["k", "attempt"], "agent", "text")
    got = {r.k: r for r in p.where("attempt = 0").collect()}
    assert {k for k, r in got.items() if r.valid} == {"good", "defaults", "empty", "stated"}
    f = got["good"].findings
    assert len(f) == 1 and (f[0].category, f[0].severity, f[0].line, f[0].recommendation, f[0].type) == ("security", "high", 3, "f", "other") and got["good"].dropped == 1 and got["good"].risk_level == "high"
    assert (got["defaults"].findings[0].confidence, got["defaults"].findings[0].severity, got["defaults"].findings[0].message) == (0.8, "medium", "m")
    assert got["stated"].risk_level == "critical" and got["null"].findings == [] and got["empty"].findings == []
    best = {r.k: r for r in first_valid(p, ["k"], "attempt").collect()}
    assert best["retry"].attempt == 1 and best["retry"].findings[0].message == "second" and best["late"].error and not best["good"].error
    assert parse_responses(df.limit(0), ["k", "attempt"], "agent", "text").count() == 0
    assert column(spark, ["a {\"x\": 1} b", "{", None], json_object) == ['{"x": 1}', None, None]


def test_policies(spark, tmp_path):
    pytest.importorskip("yaml")
    from hunkyard.sources.policies import index_text, read_policies

    (tmp_path / "security.yaml").write_text("clauses:\n- {id: S-1, content: c, title: t, tags: [a, b], severity: high}\n- {id: S-2}\n- {content: x}\n")
    (tmp_path / "zz.yaml").write_text("domain: pay\nclauses:\n- {id: P-1, content: größe}\n- {id: S-1, content: newer}\n")
    (tmp_path / "note.txt").write_text("clauses: []")
    got = {r.id: (r.domain, r.title, r.content, r.severity, r.tags) for r in read_policies(spark, str(tmp_path)).collect()}
    assert got == {"S-1": ("pay", "", "newer", "medium", []), "P-1": ("pay", "", "größe", "medium", [])}
    df = spark.createDataFrame([("a", "t", "c", ["x", "y"]), ("b", "t", "c", [])], "id string, title string, content string, tags array<string>")
    assert [r.text for r in index_text(df).orderBy("id").collect()] == ["t\nc\n关键词: x, y", "t\nc"]


def test_sinks(spark, tmp_path):
    cur = spark.createDataFrame([(1, 5, "old"), (2, 5, "keep")], "id int, ts int, v string")
    new = spark.createDataFrame([(1, 3, "a"), (1, 4, "b"), (3, 1, None)], "id int, ts int, v string")
    assert sorted(map(tuple, upsert(cur, new, "id", "ts").collect()), key=str) == [(1, 4, "b"), (2, 5, "keep"), (3, 1, None)]
    p = publish_plan(cur, spark.createDataFrame([("k9", 1)], "id string, ts int"), ["ts"])
    assert {r.action for r in p.collect()} == {"insert"}
    write_json(cur, str(tmp_path / "out"), ["id"])
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    t = trace_files(spark.createDataFrame([("0123456789abcdef", "s", None)], "trace_id string, span_id string, note string")).first()
    assert t.file == "trace-0123456789ab.json" and json.loads(t.record)["span_id"] == "s"


def test_trees_and_snapshots(spark, tmp_path):
    from hunkyard.sources.files import read_tree, snapshot

    for p, t in {"a.py": b"x = 1", "sub/b.js": "größe".encode(), "node_modules/c.js": b"", ".hid/d.py": b"", "e.txt": b"", "big.py": b"x" * 99, "bad.py": b"a\xffb"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(t)
    got = {r.path: (r.content, r.language) for r in read_tree(spark, str(tmp_path), ["py", "js"], most_bytes=50).collect()}
    assert got == {"a.py": ("x = 1", "python"), "sub/b.js": ("größe", "javascript"), "bad.py": ("a\ufffdb", "python")}
    df = spark.createDataFrame([("r", f"f{i:03}.py", 10) for i in range(8)] + [("r", "a.txt", 1), ("r", "a.py", 999), ("s", "dist/a.py", 1), (None, "z.ts", 1)], "repo string, path string, n int")
    assert sorted((r.repo or "", r.path) for r in snapshot(df, ["repo"], F.col("n"), 3, 100).collect()) == [("", "z.ts"), ("r", "f000.py"), ("r", "f001.py"), ("r", "f002.py")]


def test_results_united_and_evidence_deduplicated(spark):
    from hunkyard.operators.findings import distinct_evidence, unite

    a = spark.createDataFrame([("m", 1, None), ("n", 2, "boom")], "message string, line int, error string")
    b = spark.createDataFrame([("o", "hint")], "message string, fix string")
    got = sorted((r.source, r.message, r.line, r.fix) for r in unite({"a": a, "b": b}).collect())
    assert got == [("a", "m", 1, None), ("b", "o", None, "hint")]
    e = spark.createDataFrame([("k", "c", 2, 0.1), ("k", "c", 1, 0.9), ("k", "d", 1, 0.5)], "finding_key string, clause_id string, rank int, score double")
    assert sorted(map(tuple, distinct_evidence(e).collect())) == [("k", "c", 1, 0.9), ("k", "d", 1, 0.5)]
