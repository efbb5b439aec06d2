"""Source files of folders and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hunkyard.functions import text as T

MOST_FILES = 500
MOST_BYTES = 250_000


def read_tree(spark: SparkSession, folder: str, suffixes: list[str], excluded: list[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``path, content, language`` of the files below a folder, each read where the work is done.

    Files of other suffixes, larger ones, and those with a hidden or excluded folder in their path are left out; the
    size is filtered before contents are read. Bytes outside UTF-8 are replaced.
    """
    glob = "*.{" + ",".join(suffixes) + "}" if len(suffixes) > 1 else f"*.{suffixes[0]}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).where(F.col("length") <= most_bytes)
    base = F.lit(folder.rstrip("/") + "/")
    plain = F.regexp_replace("path", r"^file:/+", "/")
    path = F.when(plain.startswith(base), F.substring(plain, F.length(base) + 1, F.lit(1_000_000))).otherwise(plain)
    parts = F.split(path, "/")
    hidden = F.exists(parts, lambda p: p.startswith("."))
    skipped = F.arrays_overlap(parts, F.array(*map(F.lit, excluded or T.INDEX_SKIPPED_PARTS)))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return raw.where(~hidden & ~skipped).select(path.alias("path"), text.alias("content"), T.provider_language(path).alias("language"))


def snapshot(files: DataFrame, keys: list[str], size: Column, most: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The first ``most`` files of each snapshot, by path, that the index takes and that are not too large."""
    fit = files.where(T.index_language(F.col("path")).isNotNull() & (size <= most_bytes))
    w = Window.partitionBy(*keys).orderBy("path")
    return fit.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
