"""Session settings the operators are written for."""

from __future__ import annotations

from tempfile import gettempdir

from pyspark import SparkConf
from pyspark.sql import SparkSession

# AQE joins, coalesces and splits skewed partitions at run time; UTC makes
# calendar keys independent of the machine the job runs on.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Spark checks sizes against this before it broadcasts; a shuffle is
    # cheaper than building a large table on the driver.
    "spark.sql.autoBroadcastJoinThreshold": "2MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, app: str = "marketlens", memory: str = "12g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if not SparkConf().contains("spark.checkpoint.dir"):
        builder = builder.config("spark.checkpoint.dir", f"{gettempdir()}/marketlens-checkpoints")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
