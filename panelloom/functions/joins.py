"""As-of joins and calendar helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def calendar(panel: DataFrame) -> DataFrame:
    """Distinct dates with a 1-based ``idx``.  One row per day, so one small partition."""
    days = panel.select("date").distinct()
    return days.withColumn("idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], on: str = "date") -> DataFrame:
    """Attach the latest ``right`` row at or before ``left[on]`` within ``keys``.

    ``right`` has at most one row per key and ``on``.  Only the distinct ``(keys, on)``
    pairs of ``left`` are lined up with ``right`` (one pass, no pair is formed); the
    result returns by an equi-join, so many ``left`` rows on one key do not pile up.
    """
    value = [x for x in right.columns if x not in keys and x != on]
    points = left.select(*keys, on).distinct()
    typed = F.struct(*value)
    lined = points.select(*keys, on, F.lit(1).alias("__t")).unionByName(
        right.select(*keys, on, F.lit(0).alias("__t"), typed.alias("__r")), allowMissingColumns=True)
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(on, "__t").rowsBetween(Window.unboundedPreceding, 0)
    found = lined.withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__t = 1")
    return left.join(found.select(*keys, on, *[c(f"__r.{v}").alias(v) for v in value]), keys + [on], "left")
