"""Queries of problem 3: the files of a pull request packed into review chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkyard.llm.packing import LIST_ROWS, keep, pack
from hunkyard.session import durable
from hunkyard.sources.tables import table

# The budget of a review where a repository has none of its own.
DEFAULT_TOKENS = 6000
DEFAULT_CHUNKS = 24


def _files(spark: SparkSession, d: str) -> DataFrame:
    """The latest delivery of each file with a positive token count and its repository's budget.

    A file is (repo, pr, ord); a row without ord is a file of its own; rows without repo or pr belong to no pull request.
    """
    rows = table(spark, d, "diff_files").where("repo is not null and pr is not null")
    key = F.coalesce(F.col("ord").cast("string"), F.concat(F.lit("id "), F.col("diff_id").cast("string")))
    last = rows.groupBy("repo", "pr", key.alias("k")).agg(F.max(F.struct("fetched_at", "diff_id", "token_count", "file_path")).alias("v")).select("repo", "pr", "v.diff_id", "v.token_count", "v.file_path")
    b = table(spark, d, "chunk_budgets").groupBy("repo").agg(F.min(F.when(F.col("max_tokens") > 0, F.col("max_tokens"))).alias("max_tokens"), F.min(F.when(F.col("max_chunks") > 0, F.col("max_chunks"))).alias("max_chunks"))
    return (
        last.where("token_count > 0")
        .join(b, "repo", "left")
        .select(F.concat_ws("#", "repo", "pr").alias("grp"), "repo", "pr", F.col("diff_id").alias("item"), F.col("token_count").alias("tokens"), "file_path", F.coalesce("max_tokens", F.lit(DEFAULT_TOKENS)).alias("capacity"), F.coalesce("max_chunks", F.lit(DEFAULT_CHUNKS)).alias("max_chunks"))
    )


def _placed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every piece with its container and chunk; the narrow tables in between are written, as each is read again."""
    files = durable(_files(spark, d))
    pieces = durable(pack(files.select("grp", "item", "tokens", "capacity")))
    limits = files.groupBy("grp").agg(F.max("max_chunks").alias("max_chunks"), F.max("capacity").alias("max_tokens"))
    kept = keep(pieces, limits)
    placed = pieces.join(kept.select("grp", "bin", "chunk_no"), ["grp", "bin"], "left").join(files.select("item", "repo", "pr", "file_path", "capacity"), "item")
    return durable(placed), limits


def p3_assigned(spark: SparkSession, d: str) -> DataFrame:
    """One row for each piece of a file: its chunk, or none where the chunks do not suffice."""
    placed, _ = _placed(spark, d)
    return placed.select("repo", "pr", "file_path", F.col("item").alias("diff_id"), "piece", "tokens", "chunk_no", F.col("chunk_no").isNull().alias("omitted"))


def p3_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks with their files and, in rows without a chunk number, the files omitted wholly or in part.

    The omitted files of a pull request are one such row, or as many as lists of about ``LIST_ROWS`` files make, so that
    no list grows with a hot pull request; ``n_omitted`` of each of these rows counts them all.
    """
    placed, _ = _placed(spark, d)
    names = lambda c: F.transform(F.array_sort(c), lambda x: x["file_path"])
    item = F.struct("item", "file_path")
    chunks = placed.where("chunk_no is not null").groupBy("repo", "pr", "chunk_no").agg(F.sum("tokens").alias("token_count"), F.max("capacity").alias("max_tokens"), names(F.collect_set(item)).alias("source_files"))
    chunks = chunks.select("repo", "pr", "chunk_no", "token_count", "max_tokens", (F.col("max_tokens") - F.col("token_count")).alias("slack"), "source_files", F.lit(None).cast("array<string>").alias("omitted_files"), F.lit(None).cast("bigint").alias("n_omitted"))
    out = placed.where("chunk_no is null").groupBy("repo", "pr", "item", "file_path").agg(F.sum("tokens").alias("tokens"), F.max("capacity").alias("max_tokens"))
    size = out.groupBy("repo", "pr").agg(F.count("*").alias("n_omitted"))
    parts = out.join(size, ["repo", "pr"]).withColumn("part", F.pmod(F.xxhash64("item"), F.ceil(F.col("n_omitted") / LIST_ROWS)))
    rest = parts.groupBy("repo", "pr", "part").agg(F.sum("tokens").alias("token_count"), F.max("max_tokens").alias("max_tokens"), names(F.collect_list(item)).alias("omitted_files"), F.max("n_omitted").alias("n_omitted"))
    return chunks.unionByName(rest.select("repo", "pr", F.lit(None).cast("int").alias("chunk_no"), "token_count", "max_tokens", F.lit(None).cast("bigint").alias("slack"), F.lit(None).cast("array<string>").alias("source_files"), "omitted_files", "n_omitted"))


def p3_compare(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of each pull request that are kept, with their tokens and mean filling, ours and today's."""
    placed, limits = _placed(spark, d)
    kept = placed.where("chunk_no is not null").groupBy("repo", "pr", "chunk_no").agg(F.sum("tokens").alias("t"), F.max("capacity").alias("c"))
    ours = kept.groupBy("repo", "pr").agg(F.count("*").alias("chunks"), F.sum("t").alias("tokens"), F.max("c").alias("max_tokens"), F.round(F.avg(F.col("t") / F.col("c")), 4).alias("filling"))
    left = placed.where("chunk_no is null").groupBy("repo", "pr").agg(F.sum("tokens").alias("omitted_tokens"))
    r = table(spark, d, "review_chunks").groupBy("chunk_id", "repo", "pr").agg(F.max("token_count").alias("t"))
    today = r.groupBy("repo", "pr").agg(F.count("*").alias("chunks_today"), F.sum("t").alias("tokens_today"), F.avg("t").alias("mean_today"))
    j = ours.join(left, ["repo", "pr"], "left").join(today, ["repo", "pr"], "left")
    return j.select("repo", "pr", "chunks", "tokens", "filling", F.coalesce("omitted_tokens", F.lit(0)).alias("omitted_tokens"), "chunks_today", "tokens_today", F.round(F.col("mean_today") / F.col("max_tokens"), 4).alias("filling_today"))


def p3_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Files and tokens of each pull request as placed: nothing is lost, doubled or shortened on the way."""
    placed, _ = _placed(spark, d)
    return placed.groupBy("repo", "pr").agg(F.count_distinct("item").alias("files"), F.sum("tokens").cast("bigint").alias("tokens"))


QUERIES = {"p3_chunks": p3_chunks, "p3_assigned": p3_assigned, "p3_compare": p3_compare, "p3_sizes": p3_sizes}
ORACLES = {
    "p3_sizes": """WITH last AS (SELECT *, row_number() OVER (PARTITION BY repo, pr, coalesce(ord::VARCHAR, 'id ' || diff_id) ORDER BY fetched_at DESC NULLS LAST, diff_id DESC) AS n
  FROM diff_files WHERE repo IS NOT NULL AND pr IS NOT NULL)
SELECT repo, pr, count(*) AS files, sum(token_count)::BIGINT AS tokens FROM last WHERE n = 1 AND token_count > 0 GROUP BY 1, 2""",
}
