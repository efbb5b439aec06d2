import math
import random

import pytest
from pyspark.sql import functions as F

from hunkyard.operators import findings as N
from hunkyard.operators import locate as L
from hunkyard.operators import review_state as R
from hunkyard.operators.retrieve import nearest
from hunkyard.streaming.queue import OUTPUT, queue_depth, queue_state, queue_stream, step

FINDINGS = "k string, attempt int, severity string, confidence double, line int, ord int, n string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], FINDINGS)


def test_validity_and_attempts(spark):
    df = frame(spark, [
        ("a", 0, "high", 0.7, 1, 0), ("a", 0, "low", 0.3, 1, 1),
        ("b", 0, "odd", 0.9, 1, 0), ("b", 1, "low", 0.2, 1, 0), ("b", 2, "critical", 0.55, 1, 0), ("b", 3, "low", 0.9, 1, 0),
        ("c", 0, "low", None, 1, 0),
    ])
    v = N.validate(df, ["k", "attempt"], F.col("severity").isin(*N.SEVERITIES))
    got = {(r.k, r.attempt): (r.valid, r.retained, r.dropped, r.risk_level) for r in v.collect()}
    assert got["a", 0] == (True, 1, 1, "high") and got["b", 0] == (False, 0, 0, "low") and got["b", 1] == (False, 0, 0, "low") and got["b", 2] == (True, 1, 0, "critical") and not got["c", 0][0]
    c = {r.k: (r.chosen, r.tried) for r in N.choose_attempt(v, ["k"]).collect()}
    assert c == {"a": (0, 1), "b": (2, 3), "c": (None, 1)}
    assert N.validate(df.limit(0), ["k", "attempt"], F.lit(True)).count() == 0


def test_rollup_priority_and_inline(spark):
    df = frame(spark, [("a", 0, "low", 1.0, 5, 0), ("a", 0, "critical", 1.0, 0, 1), ("a", 0, "medium", 1.0, None, 2), ("a", 0, "high", 1.0, 8, 3), ("b", 0, None, 1.0, 1, 0)] + [("c", 0, r, 1.0, 1, i) for i, r in enumerate(["odd", "low", "low", "odd", "low", "low", "low"])])
    r = {x.k: x for x in N.rollup(df.drop("n"), ["k"]).collect()}
    assert r["a"].cell == "4 (2 high)" and r["a"].risk_level == "critical" and r["b"].cell == "1" and r["b"].risk_level == "low"
    p = N.prioritize(df, ["k"], "ord").orderBy("k", "urgency", "ord").collect()
    assert [(x.k, x.ord) for x in p] == [("a", 1), ("a", 3), ("a", 2), ("b", 0), ("c", 1), ("c", 2), ("c", 4), ("c", 5), ("c", 6)]
    assert {(x.k, x.ord) for x in N.inline(df).collect()} == {("a", 3)}


def test_finding_keys(spark):
    df = spark.createDataFrame([("s", 3, "m", "r"), ("s", None, "m", ""), ("s", 1, None, " ")], "s string, l int, a string, b string")
    got = [r[0] for r in df.select(N.finding_key(F.col("s"), F.col("l"), F.col("a"), F.col("b"))).collect()]
    import hashlib

    assert got == [f"s:3:{hashlib.md5(b'm r').hexdigest()[:8]}", f"s:?:{hashlib.md5(b'm').hexdigest()[:8]}", None]


@pytest.mark.parametrize("block", [4096, 7])
def test_nearest_against_brute_force(spark, block):
    r = random.Random(1)
    vec = [(i, r.randrange(3), [r.gauss(0, 1) for _ in range(6)]) for i in range(40)] + [(100, 1, None), (101, 1, [0.0] * 6)]
    df = spark.createDataFrame(vec, "id bigint, domain int, embedding array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for same in (False, True):
        got = {(x.query_id, x["rank"]): (x.clause_id, x.score) for x in nearest(df.where("id % 10 = 0 and id < 50"), df.where("id < 50"), 4, same, block).collect()}
        for q in (0, 10, 20, 30):
            want = sorted((-max(round(cos(vec[q][2], v), 6), 0.0), i) for i, d, v in vec[:40] if i != q and (not same or d == vec[q][1]))[:4]
            assert [got[q, n + 1] for n in range(len(want))] == [(i, pytest.approx(-s, abs=2e-6)) for s, i in want]
    assert nearest(df.limit(0), df, 3).count() == 0


def test_locate_snippets(spark):
    patch = "@@ -9,6 +9,7 @@\n class A:\n     pass\n-old = 1\n+new = 1\n+other = 2\n \n tail = 3"
    full = "\n".join([f"l{i}" for i in range(1, 16)] + ["def later():", "    pass"])
    files = spark.createDataFrame([(1, patch, full, "clash")], "diff_id bigint, patch string, full_content string, start_line string")
    snippets = spark.createDataFrame([(1, 1, "new = 1\nother = 2"), (2, 1, "def later():"), (3, 1, "old = 1"), (4, 1, "+ new = 1"), (5, 1, ""), (6, 1, None), (7, 1, "other = 2\n\ntail = 3"), (8, 2, "x")], "snippet_id bigint, diff_id bigint, code string")
    got = {r.snippet_id: (r.start_line, r.end_line, r.source) for r in L.locate(snippets, files).collect()}
    assert got == {1: (11, 12, "diff_hunk"), 2: (16, 16, "full_content"), 4: (11, 11, "diff_hunk")}
    assert L.locate(snippets.limit(0), files).count() == 0


def test_patches(spark):
    code = "def f():\n    a = 1\n    b = 2\n\ndef g():\n    a = 1\n"
    assert L.patch_text(code, [("a = 1", "a = 9", 6), ("    b = 2", "    b = 3", 3)]) == ("def f():\n    a = 9\n    b = 3\n\ndef g():\n    a = 1\n", 2, 0)
    assert L.patch_text(code, [("a = 1\nb = 2", "a = 5\nif a:\n    b = 6", 2)]) == ("def f():\n    a = 5\n    if a:\n        b = 6\n\ndef g():\n    a = 1\n", 1, 0)
    assert L.patch_text(code, [("", "x", 1), ("zzz", "y", 1), ("a = 1", " a = 1 ", None)]) == (code, 0, 3)
    files = spark.createDataFrame([(1, code, "z"), (2, None, "z"), (3, "x", "z")], "diff_id bigint, full_content string, ord string")
    patches = spark.createDataFrame([(1, 1, "a = 1", "a = 2", 2), (1, 2, "b = 2", "", 3), (2, 1, "a", "b", 1)], "diff_id bigint, ord int, original string, patched string, start_line int")
    got = {r.diff_id: (r.applied, r.warned, r.new_content) for r in L.apply_patches(files.drop("ord"), patches).collect()}
    assert got == {1: (2, 0, "def f():\n    a = 2\n    \n\ndef g():\n    a = 1\n")}
    state, new = L.apply_first(F.col("full_content"), F.lit(" a = 1 "), F.lit("c"))
    assert [tuple(r) for r in files.where("diff_id = 1").select(state, new).collect()] == [("applied", code.replace("a = 1", "c", 1))]


def test_markers(spark):
    df = spark.createDataFrame([("r/a", 3, "abc", "full", "b1"), ("r/a", 3, "", "full", "")], "repo string, pr int, head string, mode string, base string")
    m = R.build_marker(*(F.col(c) for c in ("repo", "pr", "head", "mode", "base")))
    assert [r[0] for r in df.select(m).collect()] == ["<!-- review-state repo=r/a pr=3 head=abc mode=full base=b1 -->", "<!-- review-state repo=r/a pr=3 head=unknown mode=full -->"]
    b = spark.createDataFrame([('x <!--review-state a=1 junk b="q" a=2\n-->y',), ("none",), (None,)], "b string")
    assert [r[0] for r in b.select(R.parse_marker(F.col("b"))).collect()] == [{"a": "2", "b": "q"}, {}, {}]
    assert [r[0] for r in b.select(R.append_marker(F.col("b"), F.lit("<!-- m -->"))).collect()] == ["x y\n\n<!-- m -->", "none\n\n<!-- m -->", "<!-- m -->".strip()]


def test_trace_summary(spark):
    s = "trace_id string, span_id string, parent_id string, name string, start_time double, end_time double, status string, exported_at timestamp, spans string"
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    rows = [("t", "R", None, "review_pr", 0.0, 2.0, "ok", t, "z"), ("t", "a", "r", "llm.bug", 0.0, 1.0, "ok", t, "z"), ("t", " A ", "r", "llm.bug", 0.0, 1.0, "error", t + dt.timedelta(1), "z"), ("t", "b", "r", "llm.security", None, None, "ok", None, "z"), ("u", "x", "gone", "n", 0.0, 1.0, "ok", t, "z"), ("u", " ", None, "n", 0.0, 1.0, "ok", t, "z")]
    got = {r.trace_id: (r.spans, r.llm_calls, r.errors, r.root_ms) for r in R.trace_summary(spark.createDataFrame(rows, s)).collect()}
    assert got == {"t": (3, 2, 1, 2000.0), "u": (1, 0, 0, None)}


def test_listing_is_capped_with_a_count(spark):
    df = spark.createDataFrame([("k", i) for i in range(25)] + [("m", 1)], "k string, i int")
    got = {r.k: r.text.split("\n") for r in R.listed(df, ["k"], [F.col("i")], F.col("i").cast("string")).collect()}
    assert len(got["k"]) == 21 and got["k"][0] == "0" and got["k"][-1] == "... and 5 more" and got["m"] == ["1"]


def ops(seed, n=400):
    r = random.Random(seed)
    return [(r.randrange(20), i, r.choice(["enqueue", "dequeue", "complete", "fail", "fail"])) for i in range(n)]


def fold(rows):
    out = {}
    for t, seq, op in sorted(rows, key=lambda x: x[1]):
        state, n, _ = out.get(t, ("", 0, -1))
        out[t] = (*step(state, n, op), seq)
    return out


def test_queue_batch_equals_stream_and_fold(spark, tmp_path):
    rows = ops(5)
    schema = "task_id bigint, seq bigint, op string"
    df = spark.createDataFrame(rows, schema)
    batch = {r.task_id: (r.state, r.retry_count, r.last_seq) for r in queue_state(df).collect()}
    assert batch == fold(rows)
    for i in range(4):
        spark.createDataFrame([x for x in rows if x[1] // 100 == i], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = queue_stream(stream).writeStream.format("memory").queryName("queue_out").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = {}
    for r in spark.sql("select * from queue_out").collect():
        if r.last_seq >= out.get(r.task_id, ("", 0, -1))[2]:
            out[r.task_id] = (r.state, r.retry_count, r.last_seq)
    assert out == batch
    assert sum(r.tasks for r in queue_depth(queue_state(df)).collect()) == len(batch)
    assert queue_state(df.limit(0)).count() == 0 and OUTPUT.startswith("task_id")


def test_two_failures_with_two_retries_are_dead(spark):
    df = spark.createDataFrame([(1, 1, "enqueue"), (1, 2, "dequeue"), (1, 3, "fail"), (2, 1, "enqueue"), (2, 2, "fail"), (2, 3, "fail")], "task_id bigint, seq bigint, op string")
    assert {r.task_id: r.state for r in queue_state(df, 2).collect()} == {1: "pending", 2: "dead"}
