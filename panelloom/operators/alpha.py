"""Evaluation of scores: rank correlation with forward returns, decile spreads, decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.functions import Frames, average_rank, calendar, nz, rank_columns, row_positions, stage
from panelloom.functions.columns import TRADING_DAYS

c = F.col
ROOT = TRADING_DAYS**0.5

# Default sub-periods of the evaluation.
SUB_PERIODS = [("2005-2012", "2005-01-01", "2012-12-31"), ("2013-2018", "2013-01-01", "2018-12-31"),
               ("2019-2026", "2019-01-01", "2026-12-31")]


def spearman(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation and pair count per group; ``pairs`` feeds several branches, so it is staged."""
    pairs = stage(pairs.select(*keys, x, y).dropna(subset=[x, y]), "pairs")
    if keys:
        ranked = rank_columns(pairs.select(*keys, c(x).alias("__rx"), c(y).alias("__ry")), keys, ["__rx", "__ry"], centred=True)
    else:
        ranked = average_rank(average_rank(pairs, keys, x, "__rx", centred=True), keys, y, "__ry", centred=True)
    # centred ranks are multiples of one half: the sums are exact and a zero correlation is zero
    dot = lambda a, b: F.sum(c(a) * c(b))
    ic = dot("__rx", "__ry") / nz(F.sqrt(dot("__rx", "__rx") * dot("__ry", "__ry")))
    agg = (ic.alias("ic"), F.count(F.lit(1)).alias("n"))
    return ranked.groupBy(*keys).agg(*agg) if keys else ranked.agg(*agg)


def forward_pairs(scores: DataFrame, panel: DataFrame, horizons: list[int], calendar_shift: bool = True) -> DataFrame:
    """``(horizon, date, ticker, score, fwd)`` for every score with a price ``h`` days ahead.

    ``calendar_shift`` counts days of the union calendar, so the instrument must have a
    price on exactly that day; otherwise the shift counts the instrument's own rows.
    """
    prices = panel.select("date", "ticker", "close").dropna()
    if calendar_shift:
        prices = prices.join(calendar(panel), "date")
    else:
        # an instrument's later rows stand in its own partition: no second exchange, no join
        w = Window.partitionBy("ticker").orderBy("date")
        ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead("close", h).over(w).alias("later")) for h in horizons])
        base = scores.join(prices.withColumn("__ahead", ahead), ["date", "ticker"]).withColumn("__a", F.explode("__ahead"))
        base = base.where("__a.later is not null")
        return base.select("__a.horizon", "date", "ticker", "score", (c("__a.later") / nz("close") - 1.0).alias("fwd"))
    base = scores.join(prices, ["date", "ticker"]).withColumn(
        "horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    ahead = prices.select("ticker", c("idx").alias("__to"), c("close").alias("__later"))
    base = base.withColumn("__to", c("idx") + c("horizon")).join(ahead, ["ticker", "__to"])
    return base.select("horizon", "date", "ticker", "score", (c("__later") / nz("close") - 1.0).alias("fwd"))


def daily_ic(
    scores: DataFrame, panel: DataFrame, horizons: list[int] | None = None, min_names: int = 20, calendar_shift: bool = True
) -> DataFrame:
    """Per horizon and date the rank correlation of scores and forward returns."""
    ic = spearman(forward_pairs(scores, panel, horizons or [21], calendar_shift), ["horizon", "date"], "score", "fwd")
    return ic.where((c("n") >= min_names) & c("ic").isNotNull())


def ic_stats(ic: DataFrame) -> DataFrame:
    sd, n = F.stddev_samp("ic"), F.count("ic").cast("double")
    one = ic.agg(F.avg("ic").alias("ic_mean"), sd.alias("ic_std"),
                 F.when(sd > 0, F.avg("ic") / nz(sd / F.sqrt(n))).otherwise(0.0).alias("ic_tstat"),
                 F.avg((c("ic") > 0).cast("double")).alias("pct_positive"), F.count("ic").alias("n_dates"))
    return one.select(
        "*", ((c("ic_mean") < 0.03) | (c("ic_tstat") < 2.0)).alias("weak_alpha"),
        ((c("ic_mean") > 0.04) & (c("ic_tstat") > 2.5)).alias("institutional_grade"))


def rolling_ic(ic: DataFrame, window: int = 126, min_rows: int = 63) -> DataFrame:
    """Rolling mean over the (daily) IC series of each horizon."""
    fr = Frames(Window.partitionBy("horizon").orderBy("date"))
    return fr.add(ic, {"rolling_ic": fr.roll(F.avg, "ic", window, min_rows)}).select("horizon", "date", "ic", "rolling_ic")


def period_table(spark: SparkSession, periods: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(periods, "period string, s string, e string").select(
        "period", F.to_date("s").alias("start"), F.to_date("e").alias("end"))


def sub_period_ic(ic: DataFrame, periods: list[tuple[str, str, str]] = SUB_PERIODS) -> DataFrame:
    """Mean IC per period (0 where a period has none) and how many periods are positive."""
    tag = F.array_compact(F.array(*[
        F.when(c("date").between(F.to_date(F.lit(s)), F.to_date(F.lit(e))), F.lit(p)) for p, s, e in periods]))
    means = ic.withColumn("period", F.explode(tag)).groupBy("period").agg(F.avg("ic").alias("m"))
    names = period_table(ic.sparkSession, periods)
    out = names.join(means, "period", "left").select("period", F.coalesce("m", F.lit(0.0)).alias("ic_mean"))
    return out.withColumn("profitable", c("ic_mean") > 0)


# -- decile spread --------------------------------------------------------------------

def decile_legs(scores: DataFrame, min_names: int = 20, share: float = 0.10) -> DataFrame:
    """Top and bottom share of every date, equal weight; ties go to the smaller ticker."""
    low = row_positions(scores, ["date"], "score", "ticker", "up")
    both = row_positions(low.drop("total").withColumn("__neg", -c("score")), ["date"], "__neg", "ticker", "down")
    k = F.greatest(F.lit(1), F.floor(c("total") * F.lit(share)))
    sides = F.array_compact(F.array(F.when(c("down") <= k, F.lit(1)), F.when(c("up") <= k, F.lit(-1))))
    return both.where(c("total") >= min_names).select(
        "date", "ticker", F.explode(sides).alias("side"), (F.lit(1.0) / k).alias("weight"))


def decile_spread(
    scores: DataFrame, panel: DataFrame, returns: DataFrame, min_names: int = 20, cost_rate: float = 0.0015,
    boundary_twice: bool = True,
) -> DataFrame:
    """Daily long-minus-short return of the decile portfolios, cost on each period's last day.

    A period runs from its score date to the next score date.  By default both ends
    count, so a boundary day appears in both periods; ``boundary_twice=False`` ends the
    period a day earlier.
    """
    cal = calendar(panel)
    last = cal.agg(F.max("idx").alias("last_idx"))
    dates = scores.select("date").distinct().join(cal, "date").join(F.broadcast(last))
    nxt = F.lead("idx").over(Window.partitionBy(F.lit(0)).orderBy("date"))
    end = F.coalesce(nxt if boundary_twice else nxt - 1, c("last_idx"))
    periods = dates.select(c("date").alias("start"), c("idx").alias("s"), end.alias("e"))
    legs = stage(decile_legs(scores, min_names).withColumnRenamed("date", "start"), "legs")
    live = legs.select("start").distinct().join(periods, "start").withColumn(
        "seq", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("start")))
    days = live.select("start", "seq", "e", F.explode(F.sequence("s", "e")).alias("idx")).join(cal, "idx")
    held = legs.join(days, "start").join(returns.select("date", "ticker", "ret"), ["date", "ticker"], "left")
    daily = held.groupBy("start", "date").agg(
        F.sum(c("side") * c("weight") * F.coalesce("ret", F.lit(0.0))).alias("spread"))
    longs = legs.where("side = 1").join(live.select("start", "seq"), "start")
    change = longs.select("seq", "ticker", "weight").unionByName(
        longs.select((c("seq") + 1).alias("seq"), "ticker", (-c("weight")).alias("weight")))
    turnover = change.groupBy("seq", "ticker").agg(F.sum("weight").alias("d")).groupBy("seq").agg(
        F.sum(F.abs("d")).alias("turnover"))
    out = days.join(daily, ["start", "date"]).join(turnover, "seq")
    cost = F.when(c("idx") == c("e"), (c("turnover") + 0.02) * cost_rate).otherwise(0.0)
    return out.select("start", "date", "spread", cost.alias("cost"), (c("spread") - cost).alias("net"))


def series_stats(series: DataFrame, keys: list[str], order: list[str], ret: str) -> DataFrame:
    """Annualised Sharpe (no risk-free rate) and maximum drawdown of return series."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    eq = series.withColumn("__eq", F.product(1.0 + c(ret)).over(w))
    dd = eq.withColumn("__dd", c("__eq") / nz(F.max("__eq").over(w)) - 1.0)
    sd = F.stddev_samp(ret)
    aggs = [F.when(sd > 0, F.avg(ret) / nz(sd) * ROOT).otherwise(0.0).alias("sharpe"),
            F.min("__dd").alias("max_drawdown"), F.count(F.lit(1)).alias("n_days")]
    return dd.groupBy(*keys).agg(*aggs) if keys else dd.agg(*aggs)


# -- decay and comparison -------------------------------------------------------------

def ic_decay_pooled(scores: DataFrame, panel: DataFrame, horizons=(1, 5, 10, 21, 63, 126), min_pairs: int = 101) -> DataFrame:
    """One rank correlation per horizon over all dates together."""
    return spearman(forward_pairs(scores, panel, list(horizons)), ["horizon"], "score", "fwd").where(c("n") >= min_pairs)


def ic_decay_daily(scores: DataFrame, panel: DataFrame, horizons=(5, 10, 21, 42, 63), min_names: int = 20) -> DataFrame:
    """Mean and deviation of the daily ICs per horizon."""
    return daily_ic(scores, panel, list(horizons), min_names).groupBy("horizon").agg(
        F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.count("ic").alias("n_obs"))


def ic_decay_shifted(scores: DataFrame, returns: DataFrame, panel: DataFrame, horizons=(1, 5, 10, 21), min_names: int = 6) -> DataFrame:
    """Mean daily IC against the single-day return ``h`` calendar days later."""
    cal = calendar(panel)
    dated = scores.join(cal, "date").withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    later = returns.select("date", "ticker", "ret").join(cal, "date").select("ticker", c("idx").alias("__to"), "ret")
    pairs = dated.withColumn("__to", c("idx") + c("horizon")).join(later, ["ticker", "__to"])
    ic = spearman(pairs, ["horizon", "date"], "score", "ret").where(c("n") >= min_names)
    return ic.groupBy("horizon").agg(F.avg("ic").alias("mean_ic"), F.count(F.lit(1)).alias("n_obs"))


def compare_experiments(results: dict[str, DataFrame]) -> DataFrame:
    """One row of IC statistics per experiment, best t-statistic first."""
    frames = [ic_stats(ic).select(F.lit(name).alias("experiment"), "*") for name, ic in results.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.orderBy(c("ic_tstat").desc(), "experiment")


def verdict(checks: dict[str, Column]) -> list[Column]:
    """Threshold checks as columns plus score and grade: all / all but two / fewer."""
    score = sum((F.coalesce(v, F.lit(False)).cast("int") for v in checks.values()), F.lit(0))
    n = len(checks)
    grade = F.when(score == n, "A").when(score >= n - 2, "B").otherwise("C")
    return [F.coalesce(v, F.lit(False)).alias(k) for k, v in checks.items()] + [score.alias("score"), grade.alias("verdict")]
