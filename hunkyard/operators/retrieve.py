"""Nearest clauses by cosine, exact, in blocks.

Queries and clauses are cut into blocks of a bounded size, inside their domain where only that counts; each pair of
blocks is one product of two small matrices, of which only the best of each query leave the task. No side is broadcast
or held whole, and nothing runs while the query is being built.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def nearest(queries: DataFrame, clauses: DataFrame, k: int, same_domain: bool = False, block: int = BLOCK) -> DataFrame:
    """``query_id, clause_id, score, rank`` of the ``k`` best clauses of each query.

    ``queries`` and ``clauses``: id, domain, embedding. Score is the cosine rounded to 6 digits, negative ones as 0; equal
    scores are ranked by clause id. A query is not matched with a clause of its own id. With ``same_domain`` only clauses
    of the query's domain count. Null or zero vectors match nothing.
    """
    dom = F.col("domain") if same_domain else F.pmod(F.xxhash64("id"), F.lit(1))  # a null domain joins with none; 0 is one domain
    q = queries.where("embedding is not null").select("id", "embedding", dom.alias("dom"))
    # columns of their own, as both sides may be one table
    c = clauses.where("embedding is not null").select(F.col("id").alias("id"), F.col("embedding").alias("embedding"), dom.alias("dom"))
    blocks = lambda df, n: df.groupBy("dom").agg(F.ceil(F.count("*") / block).alias(n))
    # one row a domain: each side learns into how many blocks the other one's domain is cut
    sizes = blocks(q, "nq").join(blocks(c, "nc"), "dom")
    if not same_domain:
        sizes = F.broadcast(sizes)  # a single row
    slot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    q = q.join(sizes, "dom").select("id", "embedding", "dom", slot("nq").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("nc").cast("int") - 1)).alias("cb"))
    c = c.join(sizes, "dom").select(F.col("id").alias("id"), F.col("embedding").alias("embedding"), F.col("dom").alias("dom"), slot("nc").alias("cb"), F.explode(F.sequence(F.lit(0), F.col("nq").cast("int") - 1)).alias("qb"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "clause_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if a.empty or b.empty:
            return out
        unit = lambda x: (m := np.stack(x.to_list()).astype(np.float64)) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        s = np.round(np.maximum(unit(a.embedding) @ unit(b.embedding).T, 0.0), 6)
        ai, bi = a.id.to_numpy(), b.id.to_numpy()
        s[ai[:, None] == bi[None, :]] = -1
        parts = []
        for i in range(len(a)):
            order = np.lexsort((bi, -s[i]))[:k]
            order = order[s[i][order] >= 0]
            parts.append(pd.DataFrame({"query_id": ai[i], "clause_id": bi[order], "score": s[i][order]}))
        return pd.concat([out, *parts])

    cand = q.groupBy("dom", "qb", "cb").cogroup(c.groupBy("dom", "qb", "cb")).applyInPandas(best, "query_id bigint, clause_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "clause_id")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))
