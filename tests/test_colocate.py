import random

import pyarrow as pa
import pytest

from hunkyard.operators.colocate import map_groups


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_groups_stay_whole_whatever_the_batches(spark, batch):
    def sums(t: pa.Table) -> pa.Table:
        """One row for each whole group; a group split over two calls would come out twice."""
        out = {}
        for k, s, v in zip(t.column("k").to_pylist(), t.column("s").to_pylist(), t.column("v").to_pylist()):
            n, total = out.get((k, s), (0, 0))
            out[k, s] = (n + 1, total + (v or 0))
        rows = [(k, s, n, total) for (k, s), (n, total) in out.items()]
        return pa.table({"k": pa.array([r[0] for r in rows], pa.string()), "s": pa.array([r[1] for r in rows], pa.int64()), "n": pa.array([r[2] for r in rows], pa.int64()), "total": pa.array([r[3] for r in rows], pa.int64())})

    r = random.Random(batch)
    rows = [(r.choice(["a", "b", "c", None]), r.choice([1, 2, None]), r.choice([1, 2, 3, None])) for _ in range(200)] + [("one", 7, 5)]
    df = spark.createDataFrame(rows, "k string, s bigint, v bigint")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted((tuple(x) for x in map_groups(df, ["k", "s"], sums, "k string, s bigint, n bigint, total bigint").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {}
    for k, s, v in rows:
        n, total = want.get((k, s), (0, 0))
        want[k, s] = (n + 1, total + (v or 0))
    assert got == sorted(((k, s, n, t) for (k, s), (n, t) in want.items()), key=str)
    assert map_groups(df.limit(0), ["k", "s"], sums, "k string, s bigint, n bigint, total bigint").count() == 0
