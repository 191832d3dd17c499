"""Shared folders and written tables, which cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables written by this process that nobody has removed yet.
STAGED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where a session on one machine names none (as in tests) a temporary folder is set; on a cluster
    that is an error, as executors don't share one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fleetlog-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    STAGED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_staged(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Removes tables staged by this process, from the ``since``-th on: call it when the results that read
    them have been written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in [p for p in STAGED[since:] if p not in keep]:
        at = hadoop.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        STAGED.remove(path)
