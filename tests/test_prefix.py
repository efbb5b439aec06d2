import random

from pyspark.sql import functions as F

from hunkyard.operators.prefix import running_before


def test_running_sums_with_hot_and_null_keys(spark):
    r = random.Random(1)
    rows = [("hot", i, r.choice([None, 1, 2, 5])) for i in r.sample(range(20_000), 3000)] + [(None, i, 1) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, o bigint, v int")
    got = {(x.k, x.o): x.s for x in running_before(df, ["k"], "o", F.col("v"), "s", span=100).collect()}
    total = 0
    for k, o, v in sorted((x for x in rows if x[0]), key=lambda x: x[1]):
        assert got[k, o] == total
        total += v or 0
    assert [got[None, i] for i in range(10)] == list(range(10))
    assert running_before(df.limit(0), ["k"], "o", F.col("v"), "s").count() == 0
