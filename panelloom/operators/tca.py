"""Execution costs as set operations over orders and candles.

``orders``: order_id, date, ticker, side, qty, limit_price.  ``candles``: date, ticker,
OHLCV.  An order meets the latest candle at or before its date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import asof_join, nz

c = F.col


def sided(side: Column) -> Column:
    return F.when(side == "BUY", 1.0).otherwise(-1.0)


def with_candle(orders: DataFrame, candles: DataFrame) -> DataFrame:
    """Each order with its candle; the lookup runs over distinct (ticker, date) pairs."""
    return asof_join(orders, candles.select("date", "ticker", "open", "high", "low", "close", "volume"), ["ticker"])


def fill_quantity(qty: Column, volume: Column, participation: float = 0.10) -> Column:
    return F.least(qty, volume * participation)


def slippage_rate(qty: Column, volume: Column, volatility: float = 0.015, slippage_bps: float = 2.0) -> Column:
    share = F.greatest(F.lit(0.0), qty / F.greatest(F.lit(1.0), volume))
    return F.lit(slippage_bps / 1e4 + 0.5 * volatility) + 0.10 * F.sqrt(share)


def commission(value: Column, fixed: float = 10.0, bps: float = 10.0) -> Column:
    return fixed + value * (bps / 1e4)


def market_fills(orders: DataFrame, spread_bps: float = 5.0) -> DataFrame:
    """Fill of every order with its candle attached: price, slippage, half spread, commission."""
    q = fill_quantity(c("qty"), c("volume"))
    df = orders.where(c("close").isNotNull()).withColumn("fill_qty", q).where("fill_qty > 0")
    df = df.withColumns({"slippage": c("close") * slippage_rate(c("fill_qty"), c("volume")), "half_spread": c("close") * (spread_bps / 2e4)})
    df = df.withColumn("fill_price", c("close") + sided(c("side")) * (c("half_spread") + c("slippage")))
    return df.withColumn("commission", commission(c("fill_price") * c("fill_qty")))


def limit_fills(orders: DataFrame) -> DataFrame:
    """Limit orders the candle's range reaches; they fill at the limit without slippage."""
    reached = F.when(c("side") == "BUY", c("low") <= c("limit_price")).otherwise(c("high") >= c("limit_price"))
    df = orders.where(reached).withColumn("fill_qty", fill_quantity(c("qty"), c("volume"))).where("fill_qty > 0")
    df = df.withColumns({"slippage": F.lit(0.0), "half_spread": F.lit(0.0), "fill_price": c("limit_price")})
    return df.withColumn("commission", commission(c("fill_price") * c("fill_qty")))


def twap_slices(orders: DataFrame, n: int = 10) -> DataFrame:
    return orders.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("qty", c("qty") / float(n))


def vwap_slices(orders: DataFrame, candles: DataFrame, n: int = 10) -> DataFrame:
    """Slices proportional to the volume of the instrument's latest ``n`` candles.

    Instruments with fewer candles use a U-shaped profile, heavy at both ends.
    """
    w = Window.partitionBy("ticker").orderBy(c("date").desc())
    last = candles.withColumn("k", F.row_number().over(w)).where(c("k") <= n)
    real = last.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct((n - c("k")).alias("slice"), c("volume").alias("v")))).alias("p"))
    shape = [(-1.5 + 3.0 * i / (n - 1)) ** 2 + 0.5 for i in range(n)] if n > 1 else [1.0]
    default = F.array(*[F.struct(F.lit(i).alias("slice"), F.lit(v).alias("v")) for i, v in enumerate(shape)])
    df = orders.join(real, "ticker", "left").withColumn("p", F.when(F.size("p") == n, c("p")).otherwise(default))
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x["v"])
    df = df.withColumn("__total", total).withColumn("x", F.explode("p"))
    share = c("x.v") / nz("__total")
    return df.withColumns({"slice": c("x.slice"), "profile_weight": share, "qty": c("qty") * share}).drop("p", "x", "__total")


def roll_up(fills: DataFrame, ordered: DataFrame) -> DataFrame:
    """Fills per order: quantity, average price, costs and status (``ordered``: order_id, qty)."""
    g = fills.groupBy("order_id").agg(
        F.sum("fill_qty").alias("filled_qty"), (F.sum(c("fill_price") * c("fill_qty")) / nz(F.sum("fill_qty"))).alias("avg_fill_price"),
        F.sum("commission").alias("total_commission"), F.sum(c("slippage") * c("fill_qty")).alias("total_slippage"),
        F.count(F.lit(1)).alias("n_fills"))
    df = ordered.join(g, "order_id", "left").fillna(0.0, ["filled_qty", "avg_fill_price", "total_commission", "total_slippage"]).fillna(0, ["n_fills"])
    # quantities of slices sum to the order only up to rounding
    status = F.when(c("filled_qty") >= c("qty") * (1 - 1e-12), "FILLED").when(c("filled_qty") > 0, "PARTIALLY_FILLED").otherwise("PENDING")
    return df.withColumn("status", status)


def report(rolled: DataFrame) -> DataFrame:
    """Fill rate and implementation shortfall against ``arrival_price`` by side."""
    rate = F.when(c("qty") > 0, c("filled_qty") / nz("qty") * 100.0).otherwise(0.0)
    gap = sided(c("side")) * (c("avg_fill_price") - c("arrival_price")) / nz("arrival_price") * 1e4
    ok = (c("arrival_price") > 0) & (c("filled_qty") > 0)
    return rolled.withColumns({"fill_rate_pct": rate, "shortfall_bps": F.when(ok, gap).otherwise(0.0)})
