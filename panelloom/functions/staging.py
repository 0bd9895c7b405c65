"""Cutting lineage and joining group statistics."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def staging_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); where none is configured, a
    folder inside the session's warehouse, which executors share as well."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    shared = shared or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_shared")
    return os.path.join(shared, f"panelloom-{spark.sparkContext.applicationId}")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended already
        pass


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Used where a result feeds several branches: later branches prune columns, see true
    sizes (so Spark itself decides about broadcasts) and survive the loss of executors.
    The files go when the session ends.  Spark keeps the shuffles behind them on disk until
    the driver's garbage is collected, so that is asked for.
    """
    path = os.path.join(staging_root(df.sparkSession), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    atexit.register(_remove, df.sparkSession, path)
    df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_stats(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Attach group aggregates to every row.

    The aggregate is combined map-side and only one row per group is joined back, so a
    group that holds a large share of the rows never sits in one task, which a window
    over ``keys`` would force.
    """
    stats = df.groupBy(*keys).agg(*[c.alias(name) for name, c in aggs.items()])
    return df.join(stats, keys, "left")
