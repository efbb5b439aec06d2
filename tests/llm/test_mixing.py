from pyspark.sql import functions as F

from hunkyard.llm.mixing import emit, rates, shares

DOCS = "doc_id bigint, source string, n_tokens int, rate string"
TARGETS = "mix_id int, source string, weight double, max_repeats int"


def make(spark):
    rows = [(i, "big", 10 + i % 7, "z") for i in range(6000)] + [(10_000 + i, "small", 20, "z") for i in range(300)] + [(20_000, None, 5, "z"), (20_001, "big", 0, "z"), (20_002, "other", 9, "z")]
    t = [(1, "big", 0.5, 2), (1, "small", 0.5, 4), (1, "absent", 0.3, 4), (2, "big", 0.9, 1), (2, "small", 0.1, 3), (2, "small", 0.1, 2), (3, "small", None, 2), (3, None, 1.0, 2), (4, "small", 0.0, 2)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(t, TARGETS)


def test_shares_limits_and_repeatability(spark):
    docs, targets = make(spark)
    r = rates(docs, targets)
    m = emit(docs, r)
    s = {(x.mix_id, x.source): x for x in shares(m, r, targets).collect()}
    assert set(s) == {(1, "big"), (1, "small"), (1, "absent"), (2, "big"), (2, "small"), (3, "small"), (4, "small")}
    assert all(abs(x.actual_share - x.reached_for) < 0.02 for x in s.values() if x.reached_for is not None)
    gone = s[1, "absent"]
    assert (gone.weight, gone.target_share, gone.reached_for, gone.actual_share, gone.rate, gone.copies) == (0.3, round(0.3 / 1.3, 6), None, 0.0, 0.0, 0)
    assert s[1, "big"].target_share == round(0.5 / 1.3, 6) and s[2, "small"].weight == 0.2 and s[4, "small"].target_share is None
    assert s[1, "small"].rate == 4.0 and s[1, "small"].copies == 1200 and s[1, "small"].most_copies == 4
    assert max(x.most_copies for x in s.values()) <= 4 and s[2, "small"].most_copies <= 2 and s[2, "big"].most_copies == 1
    again = emit(docs.repartition(7), r)
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, again.collect()))
    copies = m.where("mix_id = 1 and source = 'big'").groupBy("doc_id").count().collect()
    assert max(x["count"] for x in copies) <= 1 + int(s[1, "big"].rate)


def test_given_size_is_cut_at_the_limit(spark):
    docs, targets = make(spark)
    r = {(x.mix_id, x.source): x.rate for x in rates(docs, targets, 1e9).collect()}
    assert r[1, "big"] == 2.0 and r[1, "small"] == 4.0


def test_without_broadcast_and_empty(spark, monkeypatch):
    from hunkyard.llm import mixing

    docs, targets = make(spark)
    r = rates(docs, targets)
    want = sorted(map(tuple, emit(docs, r).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST_RATES", 1)
    assert sorted(map(tuple, emit(docs, r).collect())) == want
    assert emit(docs.limit(0), rates(docs.limit(0), targets)).count() == 0
    assert shares(emit(docs, rates(docs, targets.limit(0))), rates(docs, targets.limit(0)), targets.limit(0)).count() == 0
    assert [x.actual_share for x in shares(emit(docs.limit(0), r), r, targets).collect()] == [0.0] * 7


def test_whole_size_fills_other_sources_where_one_is_at_its_limit(spark):
    docs = spark.createDataFrame([(i, "big", 10) for i in range(8000)] + [(10_000 + i, "mid", 10) for i in range(1500)] + [(20_000 + i, "tiny", 10) for i in range(500)], "doc_id bigint, source string, n_tokens int")
    targets = spark.createDataFrame([(1, "big", 0.4, 4), (1, "mid", 0.4, 4), (1, "tiny", 0.2, 1), (2, "tiny", 1.0, 1), (3, "big", 0.5, 1), (3, "mid", 0.5, 1)], TARGETS)
    r = rates(docs, targets, whole=True)
    got = {(x.mix_id, x.source): x.rate for x in r.collect()}
    assert got[1, "tiny"] == 1.0 and abs(got[1, "big"] - 47_500 / 80_000) < 1e-9 and abs(got[1, "mid"] - 47_500 / 15_000) < 1e-9
    assert got[2, "tiny"] == 1.0 and got[3, "big"] == 1.0 and got[3, "mid"] == 1.0
    s = {(x.mix_id, x.source): x for x in shares(emit(docs, r), r, targets).collect()}
    assert abs(sum(x.mix_tokens for x in s.values() if x.mix_id == 1) - 100_000) < 2000
    assert s[1, "tiny"].target_share == 0.2 and abs(s[1, "tiny"].actual_share - 0.05) < 0.002 and s[1, "mid"].most_copies == 4
    more = docs.where("source <> 'mid'"), targets.where("mix_id = 1 and source <> 'mid'").withColumn("max_repeats", F.lit(30))
    assert all(abs(a.rate - b.rate) < 1e-9 for a, b in zip(rates(*more, whole=True).orderBy("source").collect(), rates(*more).orderBy("source").collect()))
    given = {x.source: x.rate for x in rates(docs, targets.where("mix_id = 1"), 60_000).collect()}
    assert given["tiny"] == 1.0 and abs(given["big"] - 27_500 / 80_000) < 1e-9


def test_registered_mixes_are_as_large_as_their_sources(spark, tmp_path):
    from hunkyard.llm.queries.p7_mixing import p7_shares

    text = "the reviewer asked for a test of the empty list"
    spark.createDataFrame([(i, text, "big") for i in range(400)] + [(1000 + i, text, "tiny") for i in range(20)], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "big", 0.5, 2), (1, "tiny", 0.5, 1)], TARGETS).write.parquet(f"{tmp_path}/mix_targets.parquet")
    got = {x.source: x for x in p7_shares(spark, str(tmp_path)).collect()}
    assert got["big"].copies == 400 and got["tiny"].copies == 20 and got["tiny"].target_share == 0.5
