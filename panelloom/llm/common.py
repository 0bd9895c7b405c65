"""Helpers that the corpus operators share: staging in the shared folder, word patterns,
distributed running sums."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space (space, \t \n \v \f \r).
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or, where that is
    unset (tests), a folder inside the session's warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return f"{base.rstrip('/')}/panelloom-llm-{spark.sparkContext.applicationId}"


@contextmanager
def bounded_batches(spark: SparkSession, most: str = "16m") -> Iterator[None]:
    """While a job runs, what goes to a Python worker at once is bounded by bytes, not only by
    rows: a batch of long texts or sets must not fill an executor.  A smaller bound of the
    session's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key)
    if int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(own)) > int(most[:-1]) << 20:
        spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, own)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage without local state (a lost executor loses nothing), lets later
    readers prune columns and shows Spark the true size.  Files go when the session ends,
    or earlier by :func:`unstage`.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    with bounded_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        _remove(df.sparkSession, file.rsplit("/", 1)[0])


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: its shared folder is cleared with it
        pass


def id_crc(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")))


def running_sum(df: DataFrame, group: list[str], block: str, order: list, weight: Column, out: str) -> DataFrame:
    """Exclusive running sum of ``weight`` within ``group``, in order of (block, order).

    Only the rows of one block meet in a task; blocks are chained through one summary row
    each.  Keys must not be null.
    """
    per = df.groupBy(*group, block).agg(F.sum(weight).alias("_block_sum"))
    chain = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(*group, block, F.coalesce(F.sum("_block_sum").over(chain), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(before, [*group, block])
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_before", "_inside")
    )
