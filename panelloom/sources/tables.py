"""Panel tables derived from the raw Parquet tables of one data folder.

Every method returns a lazy DataFrame.  Tables that several operators read (scores,
weights, the core feature panel) are written once per session by :func:`staged`.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.functions import by_ticker, pct_change, stage

_STAGED: dict[tuple, DataFrame] = {}


def staged(method):
    """Materialise the table on first use; reuse it for the rest of the session."""

    @wraps(method)
    def run(self):
        key = (self.spark.sparkContext.applicationId, self.path, method.__name__)
        if key not in _STAGED:
            _STAGED[key] = stage(method(self), method.__name__)
        return _STAGED[key]

    return run


class Tables:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    # -- prices ------------------------------------------------------------------
    def trades(self) -> DataFrame:
        """One row per line item in panel shape, before de-duplication."""
        d = lambda c: F.col(c).cast("double")
        price = 100.0 + d("l_extendedprice") / 10000.0
        opening = 100.0 + d("l_quantity") / 5.0
        return self.raw("lineitem").select(
            F.col("l_shipdate").cast("date").alias("date"),
            F.col("l_suppkey").cast("string").alias("ticker"),
            F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("ingest_seq"),
            opening.alias("open"),
            (F.greatest(opening, price) * (1.0 + d("l_tax") / 10.0)).alias("high"),
            (F.least(opening, price) * (1.0 - d("l_discount") / 10.0)).alias("low"),
            price.alias("close"),
            (100.0 * d("l_quantity")).alias("volume"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_returnflag",
        )

    @staged
    def panel(self) -> DataFrame:
        last = F.max(F.struct("ingest_seq", "open", "high", "low", "close"))
        day = self.trades().groupBy("date", "ticker").agg(last.alias("r"), F.sum("volume").alias("volume"))
        return day.select("date", "ticker", "r.open", "r.high", "r.low", "r.close", "volume")

    def panel_dirty(self) -> DataFrame:
        t = self.trades()
        close = (
            F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") > 45), F.lit(None).cast("double"))
            .when((F.col("l_discount") == 0) & (F.col("l_tax") == 0), F.lit(0.0))
            .when((F.col("l_linenumber") == 1) & (F.col("l_quantity") == 50), F.col("close") * 2.0)
            .otherwise(F.col("close"))
        )
        return t.select("date", "ticker", "ingest_seq", "open", "high", "low", close.alias("close"), "volume")

    @staged
    def returns(self) -> DataFrame:
        """``(date, ticker, close, ret)``; the first row of a ticker has no return."""
        return self.panel().select("date", "ticker", "close", pct_change("close", by_ticker()).alias("ret"))

    @staged
    def market(self) -> DataFrame:
        return (
            self.returns().where("ret is not null").groupBy("date").agg(F.avg("ret").alias("mkt_ret"))
        )

    def index_prices(self) -> DataFrame:
        """Market level: compounded mean return from 100, one row per day."""
        w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        return self.market().withColumn("symbol", F.lit("MKT")).select(
            "date", "symbol", (100.0 * F.exp(F.sum(F.log1p("mkt_ret")).over(w))).alias("close"), "mkt_ret"
        )

    def vix(self) -> DataFrame:
        urgent = F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double"))
        return self.raw("orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
            (12.0 + 30.0 * urgent).alias("close")
        )

    # -- dimensions --------------------------------------------------------------
    def sector_map(self) -> DataFrame:
        return (
            self.raw("supplier")
            .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("s_suppkey").cast("string").alias("ticker"),
                F.col("r_name").alias("sector"), F.col("n_name").alias("country"),
            )
        )

    def sector_benchmark(self) -> DataFrame:
        """Benchmark weight of a sector: its share of instruments."""
        per = self.sector_map().groupBy("sector").agg(F.count(F.lit(1)).cast("double").alias("k"))
        total = per.agg(F.sum("k").alias("total"))
        return per.join(total).select("sector", (F.col("k") / F.col("total")).alias("benchmark_weight"))

    def membership(self) -> DataFrame:
        from panelloom.operators.universe import membership_grid

        entries = self.raw("supplier").select(
            F.col("s_suppkey").cast("string").alias("ticker"),
            F.make_date((1995 + F.col("s_suppkey") % 5).cast("int"), F.lit(1), F.lit(1)).alias("entry_date"),
        )
        return membership_grid(entries, "1995-01-01", "2001-07-01")

    # -- derived panels ----------------------------------------------------------
    @staged
    def core(self) -> DataFrame:
        """Core features (already lagged) with keys and close."""
        from panelloom.operators.features import core_features

        return core_features(self.panel(), self.market().withColumnRenamed("mkt_ret", "ctx_ret"))

    @staged
    def distance(self) -> DataFrame:
        """The core feature that :meth:`scores` ranks; no other one is computed for it."""
        from panelloom.operators.features import core_features

        return core_features(self.panel(), only=["bollinger_distance"]).select("date", "ticker", "bollinger_distance")

    @staged
    def scores(self) -> DataFrame:
        """Cross-sectional percentile rank of the lagged Bollinger distance."""
        from panelloom.functions import percent_rank

        core_made = (self.spark.sparkContext.applicationId, self.path, "core") in _STAGED
        feature = (self.core() if core_made else self.distance()).select("date", "ticker", "bollinger_distance").dropna()
        return percent_rank(feature, ["date"], "bollinger_distance", "score").select("date", "ticker", "score")

    @staged
    def weights(self) -> DataFrame:
        """Top 5 / top 10 scores, equal weight, on the first scored date of each month."""
        from panelloom.operators.portfolio import top_k_schedule

        return top_k_schedule(self.scores(), [5, 10])

    def close_returns(self) -> DataFrame:
        return self.returns().where("ret is not null").select("date", "ticker", "ret")

    def factor_returns(self) -> DataFrame:
        joined = self.close_returns().join(self.sector_map(), "ticker")
        return joined.groupBy("date", F.col("sector").alias("factor")).agg(F.avg("ret").alias("ret"))

    # -- logs and text -----------------------------------------------------------
    def ops_log(self) -> DataFrame:
        return self.raw("events").select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"),
            F.concat(F.lit("op_"), (F.col("user_id") % 10).cast("string")).alias("operation"),
            (F.col("value") * 10.0).alias("latency_ms"),
            (F.col("event_type") != "error").alias("success"),
        )

    def alerts(self) -> DataFrame:
        v = F.col("value")
        return self.raw("events").select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"),
            F.when(v > 150, "CRITICAL").when(v > 75, "WARNING").otherwise("INFO").alias("severity"),
            F.col("event_type").alias("category"),
            F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("metric"),
            v.alias("value"), F.lit(75.0).alias("threshold"),
        )

    def news(self) -> DataFrame:
        return self.raw("documents").select(
            "doc_id", F.substring("text", 1, 80).alias("headline"),
            F.col("text").alias("content"), F.col("source").alias("symbol"),
        )
