"""Tables that all nodes can read again, and the package's path for Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Lets Spark remove a written table's shuffle files as soon as it is written: nothing reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.  Where that is unset: a local one in local mode, an error on a cluster."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where
    if (where := spark.sparkContext.getCheckpointDir()) is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='cartomill-')}")
        where = spark.sparkContext.getCheckpointDir()
    return where


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors.  discard() deletes it."""
    spark = df.sparkSession
    path = f"{scratch(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of written() that nothing reads any more; passes over None."""
    for t in tables:
        if path := getattr(t, "__dict__", {}).get("_scratch_path"):
            context = t.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver found it."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
