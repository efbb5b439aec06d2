from pyspark.sql import functions as F

from hunkyard.functions import templates as M


def test_merge_and_render(spark):
    df = spark.createDataFrame([("a", "system", "d", False), ("a", "system", "o", True), ("a", "user", "u", False), ("b", "system", "x", True)], "section string, field string, template string, is_override boolean")
    assert {(r.section, r.field): r.template for r in M.merge(df).collect()} == {("a", "system"): "o", ("a", "user"): "u", ("b", "system"): "x"}
    t = spark.createDataFrame([(" Hi {{ name }} {{name}}{{ gone }}! ",), ("",), (None,)], "t string")
    v = F.create_map(F.lit("name"), F.lit("X"))
    assert [r[0] for r in t.select(M.render(F.col("t"), v)).collect()] == ["Hi X X!", "", ""]
    assert t.select(M.render(F.col("t"), v, F.lit(" more "))).first()[0] == "Hi X X!\n\nmore"


def test_reports(spark):
    text = "FAILED a.py::x - boom\nFAILED b\n= 3 passed, 2 failed, 1 error in 2s =\n"
    df = spark.createDataFrame([(text,), (None,), ("FAILED z\n" * 20,)], "t string")
    got = [r[0] for r in df.select(M.test_report(F.col("t"))).collect()]
    assert (got[0].total, got[0].failed, got[0].errors) == (5, 3, ["a.py::x - boom", "b"])
    assert (got[1].total, got[1].failed, got[1].errors) == (0, 0, []) and len(got[2].errors) == 10
