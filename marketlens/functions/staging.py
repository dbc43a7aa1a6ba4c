"""Writing an intermediate table once, where a plan reads it several times.

The table goes to the shared folder the cluster names in
``spark.checkpoint.dir``, so it outlives any executor, and later passes read
only the parquet columns they need.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session; there is no machine-local substitute."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder every executor can reach: "
            "intermediate tables must survive the loss of an executor"
        )
    return named.rstrip("/")


def _application_dir(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/marketlens/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's part of the shared folder."""
    return f"{_application_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Compute ``df`` now, write it as parquet and return the written table.

    The tables of one application lie in one folder; :func:`drop_tables` drops
    them when its results have been read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, label: str | None = None) -> int:
    """Delete the application's written tables (those of ``label`` alone, if given).

    Frames that still read them fail afterwards. Returns how many went.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(_application_dir(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    gone = [s.getPath() for s in fs.listStatus(root) if label is None or s.getPath().getName().rsplit("-", 1)[0] == label]
    return sum(bool(fs.delete(p, True)) for p in gone)
