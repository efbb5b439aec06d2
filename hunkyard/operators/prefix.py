"""Running sums and ranks in order, with hot keys split over several tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 4096


def running_before(df: DataFrame, keys: list[str], order: str, value: Column, name: str, span: int = SPAN) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same key and smaller ``order``, an integer unique in its key.

    Each key is cut into ranges of ``span`` consecutive orders: sums per range, a running sum over the ranges and one
    inside each range. Null values count as 0; null keys are one key.
    """
    v = F.coalesce(value.cast("long"), F.lit(0).cast("long"))
    cut = df.withColumn("__v", v).withColumn("__r", F.floor(F.col(order) / F.lit(span)))
    sums = cut.groupBy(*keys, "__r").agg(F.sum("__v").alias("__s"))
    w = Window.partitionBy(*keys).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__r").alias("__rr"), F.coalesce(F.sum("__s").over(w), F.lit(0)).alias("__b"))
    inside = F.coalesce(F.sum("__v").over(Window.partitionBy(*keys, "__r").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    on = F.col("__r").eqNullSafe(F.col("__rr"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return cut.withColumn("__i", inside).join(before, on).withColumn(name, F.col("__b") + F.col("__i")).drop("__v", "__r", "__rr", "__b", "__i", *(f"__{k}" for k in keys))
