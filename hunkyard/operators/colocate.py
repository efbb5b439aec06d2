"""Whole groups, streamed through Python in batches, without one Python call per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def _last_group_start(t: pa.Table, keys: list[str]) -> int:
    """The first row of the group that the last row belongs to; rows are sorted by ``keys``."""
    cols = [t.column(k).to_pylist() for k in keys]
    n = t.num_rows - 1
    last = [c[n] for c in cols]
    while n > 0 and all(c[n - 1] == x for c, x in zip(cols, last)):
        n -= 1
    return n


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Apply ``fn`` to Arrow tables that hold one or more whole groups, sorted by ``keys``.

    Only for groups of a bounded size: a group that straddles two batches is carried over to the next call. Groups
    are spread by a hash of ``keys``; nothing but one batch and one unfinished group is in memory at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            cut = _last_group_start(t, keys)
            if cut:
                whole = pa.concat_tables([*held, t.slice(0, cut)])
                held = []
                yield from fn(whole).to_batches()
            elif held and any(held[-1].column(k)[-1].as_py() != t.column(k)[0].as_py() for k in keys):
                yield from fn(pa.concat_tables(held)).to_batches()
                held = []
            held.append(t.slice(cut))
        if held:
            yield from fn(pa.concat_tables(held)).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
