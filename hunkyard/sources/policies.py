"""Policy clauses from YAML files, as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, domain string, title string, content string, severity string, tags array<string>, source string"


def _clauses(path: str, text: str) -> Iterator[tuple]:
    import yaml

    stem = path.rpartition("/")[2].rpartition(".")[0]
    data = yaml.safe_load(text)
    items = data.get("clauses", []) if isinstance(data, dict) else data if isinstance(data, list) else []
    domain = (data.get("domain") if isinstance(data, dict) else None) or stem
    for c in items or []:
        if isinstance(c, dict) and c.get("id") and c.get("content"):
            yield str(c["id"]), str(c.get("domain") or domain), str(c.get("title") or ""), str(c["content"]), str(c.get("severity") or "medium"), [str(t) for t in c.get("tags") or []], path


def read_policies(spark: SparkSession, folder: str) -> DataFrame:
    """The clauses of all ``*.yaml`` files of a folder, read where the files are, not on the driver.

    The domain is the file's own or its name; a clause without id or content is left out; title, severity and tags have
    defaults; of several clauses of an id the one of the last file by name counts.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.yaml").load(folder).select("path", F.decode("content", "utf-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for p, t in zip(b.column("path").to_pylist(), b.column("text").to_pylist()) for r in _clauses(p, t or "")]
            names = ["id", "domain", "title", "content", "severity", "tags", "source"]
            kinds = [pa.list_(pa.string()) if n == "tags" else pa.string() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    rows = files.mapInArrow(run, SCHEMA)
    return rows.groupBy("id").agg(F.max_by(F.struct("domain", "title", "content", "severity", "tags", "source"), "source").alias("v")).select("id", "v.*")


def index_text(clauses: DataFrame) -> DataFrame:
    """``id, text`` under which a clause is indexed: title, content and, if there are any, its tags as key words."""
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("关键词: "), F.array_join("tags", ", ")))
    return clauses.select("id", F.concat_ws("\n", "title", "content", tags).alias("text"))
