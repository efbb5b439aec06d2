"""The state of tasks in a queue with retries: a batch query and its stream, with the same rules.

A task is enqueued, taken, completed or failed. A failure puts it back while its failures since it was last enqueued
stay below the most allowed, and makes it dead from then on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOST_RETRIES = 3
OUTPUT = "task_id bigint, state string, retry_count bigint, last_seq bigint"
STATE = "state string, retry_count bigint, last_seq bigint"


def queue_state(ops: DataFrame, most: int = MOST_RETRIES) -> DataFrame:
    """``task_id, state, retry_count, last_seq`` after all of ``ops`` (task_id, seq, op).

    Only three values of each task are needed, all of them plain aggregates: its last operation, when it was last
    enqueued, and how many failures came after that.
    """
    g = ops.groupBy("task_id").agg(F.max(F.struct("seq", "op")).alias("last"), F.max(F.when(F.col("op") == "enqueue", F.col("seq"))).alias("born"))
    fails = ops.where("op = 'fail'").join(g.select("task_id", "born"), "task_id").where(F.col("born").isNull() | (F.col("seq") > F.col("born"))).groupBy("task_id").agg(F.count("*").alias("fails"))
    n = F.coalesce("fails", F.lit(0))
    op = F.col("last.op")
    state = F.when(op == "enqueue", "pending").when(op == "dequeue", "processing").when(op == "complete", "done").when(n < most, "pending").otherwise("dead")
    return g.join(fails, "task_id", "left").select("task_id", state.alias("state"), n.alias("retry_count"), F.col("last.seq").alias("last_seq"))


def queue_depth(states: DataFrame) -> DataFrame:
    """Tasks in each state."""
    return states.groupBy("state").agg(F.count("*").alias("tasks"))


def step(state: str, retries: int, op: str, most: int = MOST_RETRIES) -> tuple[str, int]:
    """State and failures after one operation."""
    if op == "enqueue":
        return "pending", 0
    if op == "dequeue":
        return "processing", retries
    if op == "complete":
        return "done", retries
    return ("pending" if retries + 1 < most else "dead"), retries + 1


def queue_stream(ops: DataFrame, most: int = MOST_RETRIES) -> DataFrame:
    """The states as a stream, one row for each task of each batch; only three values a task are kept as state."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, retries, last = held.get if held.exists else ("", 0, -1)
        for b in batches:
            for seq, op in sorted(zip(b.seq, b.op)):
                if seq > last:
                    state, retries = step(state, retries, op, most)
                    last = int(seq)
        held.update((state, retries, last))
        yield pd.DataFrame({"task_id": [key[0]], "state": [state], "retry_count": [retries], "last_seq": [last]})

    return ops.groupBy("task_id").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def running_latest(events: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Events of a stream without redeliveries: the first of each key within the time that late ones may take."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def span_windows(spans: DataFrame, time: str = "exported_at", late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Spans and errors of each window and name, once the watermark has passed it."""
    return spans.withWatermark(time, late).groupBy(F.window(time, width), "name").agg(F.count("*").alias("spans"), F.count_if(F.col("status") == "error").alias("errors"))



