"""Arrays computed in a row, turned into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_of(df: DataFrame, keep: list[str], array: Column | str, present: str) -> DataFrame:
    """``keep`` and the fields of each struct of ``array``; ``present`` is a field that is never null.

    From a plain ``inline`` or ``where`` Spark derives a filter on the array's own expression and pushes it to the scan,
    which computes the array twice, and inside lambdas many times over. The outer form derives none.
    """
    return df.select(*keep, F.inline_outer(array)).where(F.col(present).isNotNull())
