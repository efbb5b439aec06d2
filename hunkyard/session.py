"""Session settings and the one way in which this library cuts lineage."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def build_session(name: str = "hunkyard", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators are written for: UTC, ANSI and adaptive plans."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that all executors share, so that a lost executor costs no earlier stage.

    The folder is the session's ``spark.checkpoint.dir``. Only a session inside one machine (``local[...]``, as in tests)
    may leave it unset and gets a temporary one; on a cluster that is an error, as executors would not share it.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="hunkyard-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df``, or where it has fewer partitions than there are cores (a small file is one task), spread over them.

    For work that costs far more than moving a row does. A scan of many files is left as it is, without a shuffle, and so
    is a plan with exchanges of its own, whose partitions are known only once it has run.
    """
    if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Make this package importable in the session's Python workers, wherever they run; once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="hunkyard-")) / "hunkyard.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
