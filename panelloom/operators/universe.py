"""Point-in-time universe, sectors, market context and traded value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import Frames, by_ticker, calendar, ffill, pct_change

c = F.col


def membership_grid(entries: DataFrame, start: str, end: str, months: int = 6) -> DataFrame:
    """Snapshots every ``months`` months: an instrument is in from its entry date on."""
    dates = F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.make_interval(months=F.lit(months)))
    return entries.select("ticker", "entry_date", F.explode(dates).alias("snapshot_date")).select(
        "snapshot_date", "ticker", (c("snapshot_date") >= c("entry_date")).alias("is_in"))


def members_at(panel: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Panel rows whose instrument belongs to the latest snapshot at or before the date.

    A date before the first snapshot, or whose snapshot has no member, keeps every row.
    The snapshot of a date is found on the (small) table of distinct dates; membership
    is then an equi-join.
    """
    active = snapshots.where("is_in").select("snapshot_date", "ticker")
    snaps = snapshots.groupBy("snapshot_date").agg(F.max("is_in").alias("any_in"))
    lined = panel.select("date").distinct().withColumn("__t", F.lit(1)).unionByName(
        snaps.select(c("snapshot_date").alias("date"), F.lit(0).alias("__t"), F.struct("snapshot_date", "any_in").alias("s")),
        allowMissingColumns=True)
    w = Window.partitionBy(F.lit(0)).orderBy("date", "__t").rowsBetween(Window.unboundedPreceding, 0)
    which = lined.withColumn("s", F.last("s", ignorenulls=True).over(w)).where("__t = 1").select(
        "date", c("s.snapshot_date").alias("snapshot_date"), F.coalesce("s.any_in", F.lit(False)).alias("any_in"))
    tagged = panel.join(which, "date")
    inside = tagged.join(active.withColumn("__in", F.lit(True)), ["snapshot_date", "ticker"], "left")
    return inside.where(c("__in") | ~c("any_in")).select(*panel.columns)


def with_sector(panel: DataFrame, sectors: DataFrame) -> DataFrame:
    return panel.join(sectors.select("ticker", "sector"), "ticker", "left").withColumn(
        "sector", F.coalesce("sector", F.lit("Other")))


def enough_history(panel: DataFrame, min_rows: int = 252) -> DataFrame:
    """Rows of instruments with at least ``min_rows`` closes."""
    long = panel.groupBy("ticker").agg(F.count("close").alias("n")).where(c("n") >= min_rows)
    return panel.join(long.select("ticker"), "ticker", "left_semi")


def sector_context(panel: DataFrame, sectors: DataFrame) -> DataFrame:
    """Mean daily return of every sector on every calendar day, absent instruments counting as 0."""
    tagged = with_sector(panel.select("date", "ticker", pct_change("close", by_ticker()).alias("ret")), sectors)
    size = tagged.groupBy("sector").agg(F.countDistinct("ticker").cast("double").alias("k"))
    day = tagged.groupBy("sector", "date").agg(F.sum("ret").alias("total"))
    n = F.lit(calendar(panel).agg(F.max("idx")).first()[0])
    grid = size.withColumn("idx", F.explode(F.sequence(F.lit(1), n))).join(calendar(panel), "idx")
    return grid.join(day, ["sector", "date"], "left").select(
        "sector", "date", (F.coalesce("total", F.lit(0.0)) / c("k")).alias("ctx_ret"))


def active_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null count per column, long form, with the activity flag."""
    counts = df.agg(*[F.count(x).alias(x) for x in columns])
    return counts.unpivot([], columns, "feature", "n_valid").withColumn("active", c("n_valid") > 0)


def traded_value(panel: DataFrame, window: int = 20, min_rows: int = 5, names: DataFrame | None = None) -> DataFrame:
    """Rolling mean of close x volume, carried forward.  With ``names``, only the instruments
    whose ``ticker`` is in that table are rolled over, each over all its rows."""
    fr = Frames()
    if names is not None:
        panel = panel.join(names.select("ticker").distinct(), "ticker", "left_semi")
    df = fr.add(panel.select("date", "ticker", "close", "volume"), {"__m": fr.roll(F.avg, c("close") * c("volume"), window, min_rows)})
    return df.select("date", "ticker", ffill("__m", by_ticker()).alias("adv"))
