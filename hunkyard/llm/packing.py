"""Items packed into containers of a fixed capacity with little room left over.

Method: minimum bin slack. For each window (container) a subset-sum over the multiset of remaining lengths, held as the
bits of one integer, picks the lengths that fill it closest to capacity; the counts are read back from the stages.

Only the histogram of lengths of a group goes to one task: at most one row for each length up to the capacity, however
many items the group has. A pattern that fits several times is used several times at once. The items themselves are
given to the slots of the patterns by a join on their rank among items of the same length.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkyard.operators.colocate import map_groups

SALTS = 32
LIST_ROWS = 10_000
SLOT_BLOCK = 10_000
KEEP_PARTS = 64


def fill(capacity: int, lengths: dict[int, int]) -> dict[int, int]:
    """The counts of lengths that fill one window best; the longest item left is always among them."""
    longest = max(lengths)
    room = capacity - longest
    stages: list[tuple[int, int, int]] = []  # length, copies, sums reachable before
    reach, limit = 1, (1 << (room + 1)) - 1
    for s in sorted(lengths, reverse=True):
        n = min(lengths[s] - (s == longest), room // s)
        k = 1
        while n > 0:
            c = min(k, n)
            stages.append((s, c, reach))
            reach = (reach | reach << (s * c)) & limit
            n -= c
            k *= 2
        if reach >> room & 1:
            break
    target = reach.bit_length() - 1
    out = {longest: 1}
    for s, c, before in reversed(stages):
        if not before >> target & 1:
            out[s] = out.get(s, 0) + c
            target -= s * c
    return out


def patterns(capacity: int, lengths: dict[int, int]) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often each is used, until no length is left; each length is at most the capacity."""
    left = dict(lengths)
    out = []
    while left:
        p = fill(capacity, left)
        times = min(left[s] // c for s, c in p.items())
        out.append((p, times))
        for s, c in p.items():
            left[s] -= c * times
            if not left[s]:
                del left[s]
    return out


def _ranges(t: pa.Table) -> pa.Table:
    g, caps, sizes, counts = (t.column(c).to_pylist() for c in ("grp", "capacity", "size", "n"))
    cols: dict[str, list] = {k: [] for k in ("grp", "size", "low", "per", "first", "times")}
    a = 0
    while a < len(g):
        b = a + 1
        while b < len(g) and g[b] == g[a]:
            b += 1
        used: dict[int, int] = {}
        first = 0
        for p, times in patterns(caps[a], dict(zip(sizes[a:b], counts[a:b]))):
            for s, c in p.items():
                for k, v in zip(cols, (g[a], s, used.get(s, 0), c, first, times)):
                    cols[k].append(v)
                used[s] = used.get(s, 0) + c * times
            first += times
        a = b
    kinds = {"grp": pa.string()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in cols.items()})


def _rank(items: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """``items`` with their rank from 0 among those of the same key, ranked in salted parts so that a hot key is split."""
    salted = items.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)).cast("int"))
    part = salted.groupBy(*key, "salt").agg(F.count("*").alias("in_part"))
    part = part.withColumn("before", F.coalesce(F.sum("in_part").over(Window.partitionBy(*key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = salted.withColumn("rn", F.row_number().over(Window.partitionBy(*key, "salt").orderBy(*order)) - 1)
    return own.join(part.select(*key, "salt", "before"), [*key, "salt"]).withColumn("rank", F.col("rn") + F.col("before"))


def pack(items: DataFrame) -> DataFrame:
    """Pieces with their container: ``grp, item, piece, tokens, bin`` for rows ``grp, item, tokens, capacity``.

    ``item`` is unique; tokens and capacity are positive. An item longer than the capacity is divided into full pieces,
    each a container of its own (bin ``item:piece``), and a rest that is packed like any other item (bin ``#number``).
    """
    cut = items.withColumn("full", F.floor(F.when(F.col("tokens") > F.col("capacity"), F.col("tokens")).otherwise(0) / F.col("capacity")).cast("int")).withColumn("size", F.col("tokens") - F.col("full") * F.col("capacity"))
    full = cut.where("full > 0").select("grp", "item", F.explode(F.sequence(F.lit(1), F.col("full"))).alias("piece"), F.col("capacity").alias("tokens"))
    full = full.withColumn("bin", F.concat_ws(":", F.col("item").cast("string"), F.col("piece").cast("string")))
    rest = cut.where("size > 0")
    hist = rest.groupBy("grp", "size").agg(F.max("capacity").alias("capacity"), F.count("*").alias("n")).select("grp", F.col("capacity").cast("long"), F.col("size").cast("long"), "n")
    slots = map_groups(hist, ["grp"], _ranges, "grp string, size bigint, low bigint, per bigint, first bigint, times bigint")
    # a pattern may be used millions of times: its slots are cut into blocks and spread before they are made
    end = F.col("per") * F.col("times") - 1
    blocks = slots.select("grp", "size", "low", "per", "first", end.alias("end"), F.explode(F.sequence(F.lit(0).cast("long"), end, F.lit(SLOT_BLOCK).cast("long"))).alias("from")).repartition("grp", "size", "from")
    slots = blocks.select("grp", "size", "low", "per", "first", F.explode(F.sequence("from", F.least(F.col("end"), F.col("from") + SLOT_BLOCK - 1))).alias("k"))
    slots = slots.select("grp", "size", (F.col("low") + F.col("k")).alias("rank"), F.concat(F.lit("#"), (F.col("first") + F.floor(F.col("k") / F.col("per"))).cast("string")).alias("bin"))
    ranked = _rank(rest.select("grp", "item", F.col("size").cast("long"), (F.col("full") + 1).alias("piece")), ["grp", "size"], [F.col("item")])
    packed = ranked.join(slots, ["grp", "size", "rank"]).select("grp", "item", "piece", F.col("size").alias("tokens"), "bin")
    return full.select("grp", "item", "piece", F.col("tokens").cast("long"), "bin").unionByName(packed)


def keep(pieces: DataFrame, limits: DataFrame) -> DataFrame:
    """``grp, bin, tokens, chunk_no`` of the containers kept: the fullest ``max_chunks`` of each group, from 1."""
    bins = pieces.groupBy("grp", "bin").agg(F.sum("tokens").alias("tokens"), F.min("item").alias("least")).join(limits, "grp")
    # a hot group's containers are ranked in parts first, so that one task gets no more than max_chunks of each part
    order = [F.desc("tokens"), F.asc("least"), F.asc("bin")]
    bins = bins.withColumn("part", F.pmod(F.xxhash64("bin"), F.lit(KEEP_PARTS)))
    bins = bins.withColumn("in_part", F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order))).where(F.col("in_part") <= F.col("max_chunks"))
    w = Window.partitionBy("grp").orderBy(*order)
    return bins.withColumn("chunk_no", F.row_number().over(w)).where(F.col("chunk_no") <= F.col("max_chunks")).select("grp", "bin", "tokens", "chunk_no")
