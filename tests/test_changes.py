from pyspark.sql import functions as F

from hunkyard.functions import text as T
from hunkyard.operators.diff import split_diff, with_added
from hunkyard.operators.responses import parse_plans

DIFF = """From: someone
diff --git a/x.py b/x.py
index 1..2 100644
--- a/x.py
+++ b/x.py
@@ -1 +1 @@
-a
+b
diff --git a/gone.js b/gone.js
deleted file mode 100644
--- a/gone.js
+++ /dev/null
@@ -1 +0,0 @@
-x
diff --git a/bin b/bin
Binary files differ
"""


def test_diff_texts_come_apart(spark):
    df = spark.createDataFrame([(1, DIFF, "clash"), (2, None, "clash"), (3, "", "clash"), (4, "no diff", "clash"), (1, DIFF, "clash")], "id int, t string, patch string")
    got = [tuple(r) for r in split_diff(df, ["id"], "t").collect()]
    one = [(1, 1, "x.py", "@@ -1 +1 @@\n-a\n+b"), (1, 2, "gone.js", "@@ -1 +0,0 @@\n-x")]
    assert sorted(got) == sorted(one * 2) and split_diff(df.limit(0), ["id"], "t").count() == 0


def test_added_lines_in_the_row(spark):
    df = spark.createDataFrame([(1, "@@ -1,2 +5,3 @@\n a\n-b\n+c\n+++ d\n\\ no\n+e\n@@ -9 +20 @@\n+f"), (2, None), (3, "")], "id int, patch string")
    assert {r.id: r.added for r in with_added(df, ["id"]).collect()} == {1: [6, 9, 20], 2: [], 3: []}


def test_plans(spark):
    rows = [
        (1, '{"patches": [{"start_line": 3, "original_snippet": "a"}, {"start_line": "4", "file_path": "b.py"}, {"start_line": "x"}, {"start_line": null}, {}], "confidence": 0.5, "affected_callers": ["f"]}'),
        (2, "no plan"), (3, None), (4, "[1]"), (5, '```json\n{"patches": "none"}\n```'), (6, ""),
    ]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("patches", F.lit("clash"))
    got = {r.id: r for r in parse_plans(df, ["id"], "t", F.lit("here.py")).collect()}
    assert [(p.file_path, p.start_line, p.original_snippet) for p in got[1].patches] == [("here.py", 3, "a"), ("b.py", 4, ""), ("here.py", 0, "")]
    assert got[1].confidence == 0.5 and got[1].affected_callers == ["f"] and got[1].parsed
    for i in (2, 3, 4, 5, 6):
        assert got[i].patches == [] and got[i].confidence == 0.8 and got[i].parsed == (i == 5)
    assert parse_plans(df.limit(0), ["id"], "t", F.lit("")).count() == 0


def test_languages_by_suffix(spark):
    df = spark.createDataFrame([("a.PY",), ("b.cpp",), ("c",), (None,)], "p string")
    assert [tuple(r) for r in df.select(T.reviewer_language(F.col("p")), T.fixer_language(F.col("p"))).collect()] == [("python", "python"), ("cpp", "python"), ("unknown", "python"), ("unknown", "python")]
