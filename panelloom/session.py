"""Session defaults; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, memory: str = "12g", **extra: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("panelloom")
    conf = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.files.maxPartitionBytes": "16m",
    } | extra
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
