"""A training mix: each source with its target share of all tokens, small sources repeated up to a limit.

Method: tokens are summed per source, repetition rates derived from them by water filling under the limits, and each document is emitted floor(rate) times
and once more with the rate's fraction as probability, drawn from a hash of mix, document and seed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_BROADCAST_RATES = 10_000


def rates(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, whole: bool = False) -> DataFrame:
    """``mix_id, source, share, tokens, max_repeats, rate`` of each source of a mix that has tokens.

    ``sizes``: source, n_tokens a document; ``targets``: mix_id, source, weight, max_repeats. Shares are the positive
    weights of the sources that have tokens, scaled to 1; several rows of a source in a mix add their weights and take
    the least limit. The size of a mix is ``total_tokens`` or, without it, the largest at which no source needs more
    repeats than allowed, so that every share is met; with ``whole``, it is at least the tokens of its sources. A source
    that would need more repeats than allowed is cut at its limit, and what it lacks is shared out over the others by
    weight, as far as their limits go.
    """
    have = sizes.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    t = targets.where("weight > 0 and max_repeats > 0 and source is not null and mix_id is not null").groupBy("mix_id", "source").agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("max_repeats"))
    j = t.join(have, "source").withColumn("most", F.col("max_repeats") * F.col("tokens").cast("double"))
    of_mix = j.groupBy("mix_id").agg(F.sum("weight").alias("all_weights"), F.sum("tokens").cast("double").alias("all_tokens"), F.min(F.col("most") / F.col("weight")).alias("least"))
    j = j.join(of_mix, "mix_id").withColumn("share", F.col("weight") / F.col("all_weights"))
    if not (total_tokens or whole):
        wanted = F.col("share") * F.col("least") * F.col("all_weights")
    else:
        size = F.lit(float(total_tokens)) if total_tokens else F.greatest("all_tokens", F.col("least") * F.col("all_weights"))
        mix = Window.partitionBy("mix_id")
        full = F.col("most") / F.col("weight")
        first = mix.orderBy(full, "source").rowsBetween(Window.unboundedPreceding, 0)
        # The mix's size when this source has just reached its limit: it and those before it are full, the others at the same level.
        at_limit = F.sum("most").over(first) + full * (F.col("all_weights") - F.sum("weight").over(first))
        j = j.withColumn("full", at_limit <= size)
        left = size - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(mix)
        level = left / F.sum(F.when(~F.col("full"), F.col("weight"))).over(mix)
        wanted = F.when(~F.col("full"), F.col("weight") * level)
    return j.select("mix_id", "source", "share", "tokens", "max_repeats", F.least(wanted / F.col("tokens"), F.col("max_repeats").cast("double")).alias("rate"))


def emit(docs: DataFrame, rate: DataFrame, seed: int = 42) -> DataFrame:
    """``mix_id, source, doc_id, copy, n_tokens``: every copy of every document in every mix.

    The draw is a hash, so the mix is the same however the data is partitioned and after any lost executor. Repeated
    rows of a document get the same draw each. Documents without source or tokens are in no mix.
    """
    small = rate.select("mix_id", "source", "rate")
    held = small.limit(MAX_BROADCAST_RATES + 1).collect()
    if len(held) <= MAX_BROADCAST_RATES:
        small = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in held], small.schema))
    j = docs.select("doc_id", "source", "n_tokens").where("n_tokens > 0").join(small, "source")
    draw = F.pmod(F.xxhash64(F.col("mix_id"), F.col("doc_id"), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    n = (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    j = j.withColumn("n", n).where("n > 0")
    return j.select("mix_id", "source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"), "n_tokens")


def shares(mix: DataFrame, rate: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share, tokens, copies and most copies of every source that a mix asks for.

    ``weight`` and ``target_share`` are as asked, over all sources of the mix; ``reached_for`` is the share among those
    that have tokens, which the rates aim at. A source without tokens has null there, a rate and an actual share of 0.
    Several rows of a source in a mix are one; rows without mix or source are left out.
    """
    asked = targets.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("weight"), F.min("max_repeats").alias("max_repeats"))
    whole = asked.groupBy("mix_id").agg(F.sum("weight").alias("all_weights"))
    per_doc = mix.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("mix_tokens"), F.count("*").alias("copies"), F.max("copy").alias("most_copies"))
    total = per_doc.groupBy("mix_id").agg(F.sum("mix_tokens").alias("all_tokens"))
    j = asked.join(whole, "mix_id").join(rate.select("mix_id", "source", "share", "rate"), ["mix_id", "source"], "left").join(per_doc, ["mix_id", "source"], "left").join(total, "mix_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    return j.select(
        "mix_id",
        "source",
        "weight",
        F.round(F.try_divide("weight", "all_weights"), 6).alias("target_share"),
        F.round("share", 6).alias("reached_for"),
        F.round(F.coalesce(F.col("mix_tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"),
        F.round(F.coalesce("rate", F.lit(0.0)), 6).alias("rate"),
        "max_repeats",
        none("mix_tokens").alias("mix_tokens"),
        none("copies").alias("copies"),
        none("most_copies").alias("most_copies"),
    )
