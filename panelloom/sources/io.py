"""Readers and writers: panels, vendor tables, versions, reports, run logs."""

from __future__ import annotations

import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def write_panel(panel: DataFrame, path: str) -> None:
    """Partition by year, so that a date range prunes directories; Spark sizes the files by the data."""
    panel.withColumn("year", F.year("date")).hint("rebalance", "year").write.partitionBy("year").mode("overwrite").parquet(path)


def read_panel(spark: SparkSession, path: str, tickers: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Price panel of the given tickers and inclusive date range; filters reach the scan."""
    df = spark.read.parquet(path)
    if start:
        df = df.where((c("year") >= int(start[:4])) & (c("date") >= F.lit(start).cast("date")))
    if end:
        df = df.where((c("year") <= int(end[:4])) & (c("date") <= F.lit(end).cast("date")))
    if tickers is not None:
        df = df.where(c("ticker").isin(tickers))
    return df.drop("year")


def read_symbol(series: DataFrame, symbol: str) -> DataFrame:
    """One macro or benchmark symbol as a flat series."""
    return series.where(c("symbol") == symbol).drop("symbol", "ticker")


def wide_to_long(wide: DataFrame, date: str = "date", sep: str = "|", suffix: str = r"\.NS$") -> DataFrame:
    """Vendor table with a column per ``ticker|Field`` to a long panel.

    Strips the exchange suffix, lower-cases fields and drops rows without a close.
    """
    fields = ["open", "high", "low", "close", "volume"]
    values = [x for x in wide.columns if sep in x]
    by_ticker: dict[str, dict[str, str]] = {}
    for x in values:
        t, f = x.rsplit(sep, 1)
        by_ticker.setdefault(t, {})[f.lower()] = x
    rows = F.array(*[
        F.struct(F.lit(t).alias("ticker"), *[
            (c(f"`{cols[f]}`").cast("double") if f in cols else F.lit(None).cast("double")).alias(f) for f in fields])
        for t, cols in by_ticker.items()])
    long = wide.select(c(date).alias("date"), F.explode(rows).alias("r")).select("date", "r.*")
    return long.withColumn("ticker", F.regexp_replace("ticker", suffix, "")).dropna(subset=["close"])


def concat_batches(*batches: DataFrame) -> DataFrame:
    """Union by name; the fundamental columns exist afterwards, null where unknown."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out.withColumns({f: F.lit(None).cast("double") for f in ("roe", "roa", "earnings_growth") if f not in out.columns})


# -- versions ----------------------------------------------------------------------------

def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content hash: exclusive-or and sum of row hashes, and the row count."""
    h = F.xxhash64(*[F.coalesce(c(x).cast("string"), F.lit("\0")) for x in sorted(df.columns)])
    return df.select(h.alias("h")).agg(
        F.bit_xor("h").alias("x"), F.sum(c("h").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("row_count"))


def create_version(df: DataFrame, name: str, root: str, start: str, end: str, created_at: datetime | None = None) -> str:
    """Write a snapshot and append its manifest row; an empty table is refused."""
    f = fingerprint(df).first()
    if f.row_count == 0:
        raise ValueError("an empty table cannot become a version")
    now = created_at or datetime.now(timezone.utc)
    digest = f"{(f.x ^ int(f.s)) & 0xFFFFFFFFFFFFFFFF:016x}"
    version = f"{name}_v{now:%Y%m%d}_{digest[:8]}"
    path = os.path.join(root, "versions", version)
    df.write.mode("overwrite").parquet(path)
    row = [(version, name, digest, f.row_count, df.columns, start, end, path, now.isoformat())]
    schema = ("version_id string, dataset_name string, hash_key string, row_count bigint, columns array<string>, "
              "start_date string, end_date string, file_path string, created_at string")
    df.sparkSession.createDataFrame(row, schema).write.mode("append").parquet(os.path.join(root, "manifest"))
    return version


def list_versions(spark: SparkSession, root: str, name: str | None = None) -> DataFrame:
    """Manifest rows, newest first."""
    m = spark.read.parquet(os.path.join(root, "manifest"))
    return (m if name is None else m.where(c("dataset_name") == name)).orderBy(c("created_at").desc(), "version_id")


def load_version(spark: SparkSession, root: str, version_id: str) -> DataFrame:
    row = list_versions(spark, root).where(c("version_id") == version_id).first()
    if row is None:
        raise FileNotFoundError(f"no version {version_id}")
    return spark.read.parquet(row.file_path)


# -- reports -----------------------------------------------------------------------------

def export_report(daily: DataFrame, monthly: DataFrame, metrics: DataFrame, root: str) -> dict[str, str]:
    """Equity, returns, drawdown and monthly tables as CSV, scalar metrics as JSON."""
    parts = {
        "equity_curve": daily.select("portfolio_id", "date", "equity"), "daily_returns": daily.select("portfolio_id", "date", "net"),
        "drawdown_series": daily.select("portfolio_id", "date", "drawdown"), "monthly_returns": monthly,
    }
    paths = {k: os.path.join(root, k) for k in parts}
    for k, df in parts.items():
        df.write.mode("overwrite").option("header", True).csv(paths[k])
    paths["summary"] = os.path.join(root, "summary")
    metrics.write.mode("overwrite").json(paths["summary"])
    return paths


def append_runs(runs: DataFrame, path: str) -> None:
    """Append records to a JSON-lines run log."""
    runs.write.mode("append").json(path)
