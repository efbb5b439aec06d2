"""The plans of the registered queries: no join that pairs everything, and scans that read what is needed."""

import os
import re

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test data here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(k for k in __spark_entry__.queries() if not re.match(r"p[2-8]_", k)))
def test_no_query_pairs_all_rows(spark, name):
    text = plan(__spark_entry__.queries()[name](spark, SF))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", text), text


def test_scans_are_pruned(spark):
    q = __spark_entry__.queries()
    for name, table, wanted in [("hunk_parse", "diff_files", {"diff_id", "patch"}), ("language_detect", "diff_files", {"diff_id", "file_path"}), ("index_sizes", "source_files", {"repo", "path", "content", "language"})]:
        scan = re.findall(r"ReadSchema: struct<([^\n]*)", plan(q[name](spark, SF)))
        assert scan, name
        assert {c.split(":")[0] for s in scan for c in re.split(r",(?=\w+:)", s.rstrip(">"))} == wanted, (name, scan, table)
    assert "attributes" not in plan(q["trace_summary"](spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(event_type,click\)", plan(q["push_join"](spark, SF)))


@pytest.mark.parametrize("name", ["callers_depth2", "context_topk", "impact_risk", "import_callers"])
def test_snapshots_are_read_once(spark, name):
    assert plan(__spark_entry__.queries()[name](spark, SF)).count("source_files.parquet") <= 1


@pytest.mark.parametrize("name", ["hunk_parse", "added_lines_index", "hunk_context", "chunk_pack", "chunk_cap", "text_symbols", "text_dependencies", "changed_symbols", "snippet_locate"])
def test_no_array_is_computed_again_in_a_filter(spark, name):
    text = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in text.split("\n") if re.match(r"[\s:+-]*(?:Filter|Join)", x) and "transform(" in x]


def test_queries_and_sql_have_the_same_names():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and "chunk_pack" in o


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["diff_id", "chunk_no", "token_count", "compressed"] and df.count() > 0
