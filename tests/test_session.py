from pyspark.sql import functions as F

from hunkyard.session import spread


def test_small_scans_are_spread_and_nothing_runs_for_it(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    assert spread(one).rdd.getNumPartitions() == cores and spread(one).count() == 100
    many = spark.range(0, 100, 1, cores + 3)
    assert spread(many).rdd.getNumPartitions() == cores + 3
    grouped = one.groupBy((F.col("id") % 3).alias("k")).count()
    assert spread(grouped) is grouped
