"""Backtest of weight schedules over a trading calendar.

Holdings stay sparse: one row per portfolio, day and held name.  Differences between
days come from grouping each row with its own and the next day, so no dense date x
instrument grid is built.  Only daily portfolio series (one row per day) use ordered
windows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import Frames, asof_join, calendar, nz, quantiles, stage
from panelloom.functions.columns import TRADING_DAYS

c = F.col
ROOT = TRADING_DAYS**0.5
PD = ["portfolio_id", "date"]


@dataclass(frozen=True)
class Config:
    """Default rates of the backtest."""

    capital: float = 10_000_000.0
    cost_rate: float = 0.0015
    impact: float = 0.1
    impact_power: float = 2.0
    adv_multiplier: float = 1.0
    target_vol: float = 0.18
    vol_targeting: bool = True
    lag: int = 1
    risk_free: float = 0.065
    window: int = 63


def by_portfolio():
    return Window.partitionBy("portfolio_id").orderBy("date")


def dense_exposure(cal: DataFrame, exposure: DataFrame | None) -> DataFrame:
    """Exposure on every calendar day: latest value, 1 before the first."""
    if exposure is None:
        return cal.select("date", "idx", F.lit(1.0).alias("exposure"))
    e = asof_join(cal, exposure.select("date", "exposure"), [], "date")
    return e.select("date", "idx", F.coalesce("exposure", F.lit(1.0)).alias("exposure"))


def holdings(weights: DataFrame, cal: DataFrame, exposure: DataFrame | None = None, lag: int = 1) -> DataFrame:
    """Daily weights: held until the next rebalance, scaled by exposure, effective ``lag`` days later.

    Rebalances that are not calendar days are ignored.
    """
    n = cal.agg(F.max("idx")).first()[0]
    sched = weights.join(cal.select(c("date").alias("rebal_date"), c("idx").alias("s")), "rebal_date")
    spans = sched.select("portfolio_id", "s").distinct().withColumn(
        "e", F.coalesce(F.lead("s").over(Window.partitionBy("portfolio_id").orderBy("s")), F.lit(n + 1)) - 1)
    days = dense_exposure(cal, exposure).select(c("idx").alias("signal_idx"), "exposure")
    held = sched.join(spans, ["portfolio_id", "s"]).withColumn("signal_idx", F.explode(F.sequence("s", "e")))
    held = held.join(days, "signal_idx").withColumn("idx", c("signal_idx") + lag).join(cal, "idx")
    return held.select("portfolio_id", "date", "idx", "ticker", (c("weight") * c("exposure")).alias("weight")).where("weight <> 0")


def daily_grid(weights: DataFrame, cal: DataFrame) -> DataFrame:
    """Every portfolio on every calendar day."""
    n = cal.agg(F.max("idx")).first()[0]
    ids = weights.select("portfolio_id").distinct().withColumn("idx", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return ids.join(cal, "idx")


def gross_returns(held: DataFrame, returns: DataFrame, grid: DataFrame) -> DataFrame:
    """Sum of weight x return per day; a day without trade or holding counts 0."""
    r = held.join(returns.select("date", "ticker", "ret"), ["date", "ticker"]).groupBy(*PD).agg(
        F.sum(c("weight") * c("ret")).alias("gross"))
    return grid.join(r, PD, "left").fillna(0.0, ["gross"])


def vol_scalar(daily: DataFrame, ret: str = "gross", target: float = 0.18, lookback: int = 60, low: float = 0.2, high: float = 1.0) -> DataFrame:
    """Target volatility over realised volatility (20 rows needed), clipped; 1 while unknown."""
    fr = Frames(by_portfolio())
    vol = fr.roll(F.stddev_samp, ret, lookback, 20) * ROOT
    # zero volatility is an infinite ratio, clipped to the upper bound
    ratio = F.when(c("__vol").isNull(), 1.0).when(c("__vol") == 0, high).otherwise(
        F.greatest(F.lit(low), F.least(F.lit(high), target / nz("__vol"))))
    return fr.add(daily, {"__vol": vol}).withColumn("scalar", ratio).select(*daily.columns, "scalar")


def trades(held: DataFrame) -> DataFrame:
    """Absolute change of every name's weight from one day to the next; rounding noise is no trade."""
    now = held.select("portfolio_id", "idx", "ticker", "weight")
    before = held.select("portfolio_id", (c("idx") + 1).alias("idx"), "ticker", (-c("weight")).alias("weight"))
    change = now.unionByName(before).groupBy("portfolio_id", "idx", "ticker").agg(F.sum("weight").alias("d"))
    return change.where("idx > 1").select("portfolio_id", "idx", "ticker", F.abs("d").alias("trade")).where("trade > 1e-12")


def costs(moved: DataFrame, cal: DataFrame, adv: DataFrame | None, cfg: Config) -> DataFrame:
    """Turnover, fixed cost and market impact per day.

    ``adv``: ``(date, ticker, adv)``; the latest value at or before the trade counts, a
    missing one is 1, the floor is 1.
    """
    t = moved.join(cal, "idx")
    if adv is None:
        t = t.withColumn("__impact", F.lit(0.0))
    else:
        t = asof_join(t, adv.select("date", "ticker", "adv"), ["ticker"])
        floor = F.greatest(F.coalesce("adv", F.lit(1.0)), F.lit(1.0)) * cfg.adv_multiplier
        t = t.withColumn("__impact", cfg.impact * F.pow(c("trade") * cfg.capital / floor, cfg.impact_power))
    return t.groupBy(*PD).agg(
        F.sum("trade").alias("turnover"), (F.sum("trade") * cfg.cost_rate).alias("fixed_cost"),
        F.sum("__impact").alias("impact_cost"))


def run(
    weights: DataFrame, returns: DataFrame, cal: DataFrame, exposure: DataFrame | None = None,
    adv: DataFrame | None = None, cfg: Config = Config(),
) -> DataFrame:
    """Daily table: gross, scalar, turnover, costs, net, equity, drawdown."""
    held = holdings(weights, cal, exposure, cfg.lag)
    grid = daily_grid(weights, cal)
    if cfg.vol_targeting:
        held = stage(held, "held")
        daily = stage(vol_scalar(gross_returns(held, returns, grid), target=cfg.target_vol), "gross")
        held = held.join(daily.select(*PD, "scalar"), PD).select(
            "portfolio_id", "date", "idx", "ticker", (c("weight") * c("scalar")).alias("weight"))
        daily = daily.withColumn("gross", c("gross") * c("scalar"))
    else:
        daily = gross_returns(held, returns, grid).withColumn("scalar", F.lit(1.0))
    paid = costs(trades(held), cal, adv, cfg)
    out = daily.join(paid, PD, "left").fillna(0.0, ["turnover", "fixed_cost", "impact_cost"])
    out = out.withColumn("net", c("gross") - c("fixed_cost") - c("impact_cost"))
    return equity(out, cfg.capital).select(
        *PD, "gross", "scalar", "turnover", "fixed_cost", "impact_cost", "net", "equity", "drawdown")


def equity(daily: DataFrame, capital: float, ret: str = "net") -> DataFrame:
    w = by_portfolio().rowsBetween(Window.unboundedPreceding, 0)
    out = daily.withColumn("equity", capital * F.product(1.0 + c(ret)).over(w))
    return out.withColumn("drawdown", c("equity") / nz(F.max("equity").over(w)) - 1.0)


def scaled_holdings(weights: DataFrame, returns: DataFrame, cal: DataFrame, exposure=None, cfg: Config = Config()) -> DataFrame:
    """The holdings that :func:`run` trades, after volatility targeting."""
    held = stage(holdings(weights, cal, exposure, cfg.lag), "held")
    daily = vol_scalar(gross_returns(held, returns, daily_grid(weights, cal)), target=cfg.target_vol)
    return held.join(daily.select(*PD, "scalar"), PD).select(
        "portfolio_id", "date", "idx", "ticker", (c("weight") * c("scalar")).alias("weight"))


# -- metrics ------------------------------------------------------------------------

def _active(daily: DataFrame) -> DataFrame:
    """Flag rows from the first day with a non-zero return."""
    w = Window.partitionBy("portfolio_id")
    first = F.min(F.when(F.abs("net") > 1e-9, c("date"))).over(w)
    return daily.withColumn("__first", first).withColumn("__on", F.coalesce(c("date") >= c("__first"), F.lit(False)))


def _common(on: Column) -> dict[str, Column]:
    return {
        "__e0": F.min_by("equity", "date"), "__e1": F.max_by("equity", "date"),
        "__ea": F.min_by(F.when(on, c("equity")), F.when(on, c("date"))),
        "__na": F.count(F.when(on, 1)).cast("double"), "__n": F.count(F.lit(1)).cast("double"),
        "__d0": F.min("date"), "__d1": F.max("date"), "max_drawdown": F.min("drawdown"),
        "__mean": F.avg(F.when(on, c("net"))), "__sd": F.stddev_samp(F.when(on, c("net"))),
        "__sdall": F.stddev_samp("net"), "__turn": F.avg("turnover"),
        "__fixed": F.sum("fixed_cost"), "__impact": F.sum("impact_cost"),
    }


def summary(daily: DataFrame) -> DataFrame:
    """Full-period metrics without a risk-free rate."""
    df = _active(daily)
    g = df.groupBy("portfolio_id").agg(*[v.alias(k) for k, v in _common(c("__on")).items()])
    years = F.greatest(F.datediff("__d1", "__d0") / 365.25, F.lit(1.0 / 365))
    cagr = F.when(c("__na") > 0, F.pow(c("__e1") / nz("__ea"), TRADING_DAYS / nz("__na")) - 1.0).otherwise(0.0)
    g = g.withColumn("cagr", cagr)
    return g.select(
        "portfolio_id", "cagr", (c("__sdall") * ROOT).alias("ann_vol"),
        F.when(c("__sd") > 0, c("__mean") / nz("__sd") * ROOT).otherwise(0.0).alias("sharpe_ratio"),
        "max_drawdown", (c("cagr") / nz(F.abs("max_drawdown"))).alias("calmar_ratio"),
        (c("__e1") / nz("__e0") - 1.0).alias("total_return"), c("__e1").alias("final_equity"),
        (c("__turn") * TRADING_DAYS).alias("ann_turnover"),
        (c("__fixed") * 1e4 / years).alias("ann_fixed_cost_bp"), (c("__impact") * 1e4 / years).alias("ann_impact_cost_bp"))


def full_metrics(daily: DataFrame, benchmark: DataFrame | None = None, cfg: Config = Config()) -> DataFrame:
    """Active-period metrics against a risk-free rate, with Sortino and information ratio."""
    df = _active(daily)
    on = c("__on") | c("__first").isNull()
    aggs = _common(c("__on")) | {
        "__amean": F.avg(F.when(on, c("net"))), "__asd": F.stddev_samp(F.when(on, c("net"))),
        "__down": F.stddev_samp(F.when(on & (c("net") < 0), c("net"))),
        "__nd": F.count(F.when(on & (c("net") < 0), 1)),
    }
    if benchmark is not None:
        df = df.join(benchmark.select("date", c("mkt_ret").alias("__b")), "date", "left").fillna(0.0, ["__b"])
        bet = F.when(on, c("net") - c("__b"))
        aggs |= {"__im": F.avg(bet), "__is": F.stddev_samp(bet)}
    g = df.groupBy("portfolio_id").agg(*[v.alias(k) for k, v in aggs.items()])
    rf = (1 + cfg.risk_free) ** (1 / TRADING_DAYS) - 1
    active_years = F.greatest(c("__na") / TRADING_DAYS, F.lit(1e-3))
    g = g.withColumn("cagr", F.when(c("__na") > 0, F.pow(c("__e1") / nz("__ea"), 1.0 / active_years) - 1.0).otherwise(0.0))
    down = F.when(c("__nd") > 1, c("__down") * ROOT).otherwise(1e-8)
    years = F.greatest(c("__n") / TRADING_DAYS, F.lit(1e-4))
    ir = F.when(c("__is") > 0, c("__im") / nz("__is") * ROOT).otherwise(0.0) if benchmark is not None else F.lit(None).cast("double")
    return g.select(
        "portfolio_id", "cagr", (c("__asd") * ROOT).alias("ann_vol"),
        F.when(c("__asd") > 0, (c("__amean") - rf) / nz("__asd") * ROOT).otherwise(0.0).alias("sharpe_ratio"),
        F.when(down > 0, (c("__amean") * TRADING_DAYS - cfg.risk_free) / nz(down)).otherwise(0.0).alias("sortino_ratio"),
        ir.alias("information_ratio"), "max_drawdown",
        (c("cagr") / nz(F.abs("max_drawdown"))).alias("calmar_ratio"),
        (c("__e1") / nz("__e0") - 1.0).alias("total_return"), c("__e1").alias("final_equity"),
        (c("__turn") * TRADING_DAYS).alias("ann_turnover"),
        (c("__fixed") * 1e4 / years).alias("ann_fixed_cost_bp"), (c("__impact") * 1e4 / years).alias("ann_impact_cost_bp"))


def rolling_metrics(daily: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Rolling Sharpe, volatility, Sortino and worst drawdown inside the window.

    The drawdown walks a window-wide array per day; the series has one row per day.
    """
    n, need = cfg.window, max(20, cfg.window // 3)
    fr = Frames(by_portfolio())
    mean, sd = fr.roll(F.avg, "net", n, need), fr.roll(F.stddev_samp, "net", n, need)
    frame = by_portfolio().rowsBetween(-(n - 1), 0)
    neg = F.when(c("net") < 0, c("net"))
    rf = (1 + cfg.risk_free) ** (1 / TRADING_DAYS) - 1
    df = fr.add(daily, {
        "__m": mean, "__s": sd, "__down": F.stddev_samp(neg).over(frame), "__nd": F.count(neg).over(frame),
        "__path": F.collect_list("net").over(frame),
    })
    down = F.when(c("__nd") > 1, c("__down")).otherwise(1e-8)
    step = lambda s, r: F.struct(
        (s["eq"] * (1.0 + r)).alias("eq"), F.greatest(s["peak"], s["eq"] * (1.0 + r)).alias("peak"),
        F.least(s["dd"], s["eq"] * (1.0 + r) / nz(F.greatest(s["peak"], s["eq"] * (1.0 + r))) - 1.0).alias("dd"))
    start = F.struct(F.lit(1.0).alias("eq"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("dd"))
    worst = F.aggregate("__path", start, step, lambda s: s["dd"])
    return df.select(
        *PD, ((c("__m") - rf) / nz("__s") * ROOT).alias("rolling_sharpe"), (nz("__s") * ROOT).alias("rolling_vol"),
        F.when(c("__m").isNotNull() & (down > 0), (c("__m") * TRADING_DAYS - cfg.risk_free) / nz(down * ROOT)).alias("rolling_sortino"),
        F.when(c("__m").isNotNull(), worst).alias("rolling_max_dd"))


def monthly_returns(daily: DataFrame) -> DataFrame:
    return daily.groupBy("portfolio_id", F.trunc("date", "month").alias("month")).agg(
        (F.product(1.0 + c("net")) - 1.0).alias("monthly_return"))


def month_pivot(monthly: DataFrame) -> DataFrame:
    """Years down, months across."""
    m = monthly.select("portfolio_id", F.year("month").alias("year"), F.month("month").alias("m"), "monthly_return")
    return m.groupBy("portfolio_id", "year").agg(
        *[F.max(F.when(c("m") == k, c("monthly_return"))).alias(f"m{k:02d}") for k in range(1, 13)])


def exposure_panel(held: DataFrame, daily: DataFrame) -> DataFrame:
    """Currency holding of every name."""
    return held.join(daily.select(*PD, "equity"), PD).select(*PD, "ticker", (c("weight") * c("equity")).alias("holding"))


def exposure_series(held: DataFrame, grid: DataFrame) -> DataFrame:
    """Gross and net exposure, concentration and effective number of names per day."""
    s = held.groupBy(*PD).agg(
        F.sum(F.abs("weight")).alias("g"), F.sum("weight").alias("n"), F.sum(c("weight") * c("weight")).alias("q"))
    df = grid.join(s, PD, "left").fillna(0.0, ["g", "n", "q"])
    hhi = F.coalesce(c("q") / nz(c("n") * c("n")), F.lit(0.0))
    return df.select(*PD, c("g").alias("gross_exposure"), c("n").alias("net_exposure"), hhi.alias("hhi"),
                     F.coalesce(F.lit(1.0) / nz(hhi), F.lit(0.0)).alias("effective_n"))


# -- factor attribution ----------------------------------------------------------------

def factor_regression(daily: DataFrame, factors: DataFrame, names: list[str], min_rows: int = 30) -> DataFrame:
    """Least squares of net returns on wide factor returns, with intercept.

    One aggregate collects the moments of all variables; the small normal equations are
    solved per portfolio by elimination on columns.
    """
    df = daily.join(factors.select("date", *names), "date").fillna(0.0, names)
    k = len(names)
    n = F.count(F.lit(1)).cast("double")
    aggs = {"__n": n, "__my": F.avg("net"), "__vy": F.var_pop("net")}
    for i, a in enumerate(names):
        aggs[f"__m{i}"] = F.avg(a)
        aggs[f"__y{i}"] = F.covar_pop(a, "net")
        for j in range(i, k):
            aggs[f"__c{i}_{j}"] = F.covar_pop(a, names[j])
    g = df.groupBy("portfolio_id").agg(*[v.alias(x) for x, v in aggs.items()]).where(c("__n") >= min_rows)
    m = [[c(f"__c{min(i, j)}_{max(i, j)}") for j in range(k)] + [c(f"__y{i}")] for i in range(k)]
    for p in range(k):  # elimination; each step becomes named columns to keep expressions flat
        for i in range(p + 1, k):
            f = m[i][p] / nz(m[p][p])
            cols = {f"__e{p}_{i}_{j}": m[i][j] - f * m[p][j] for j in range(p, k + 1)}
            g = g.withColumns(cols)
            m[i] = m[i][:p] + [c(x) for x in cols]
    beta: list[Column] = [F.lit(0.0)] * k
    for i in reversed(range(k)):
        rest = sum((m[i][j] * beta[j] for j in range(i + 1, k)), F.lit(0.0))
        g = g.withColumn(f"beta_{names[i]}", (m[i][k] - rest) / nz(m[i][i]))
        beta[i] = c(f"beta_{names[i]}")
    explained = sum((beta[i] * c(f"__y{i}") for i in range(k)), F.lit(0.0))
    alpha = c("__my") - sum((beta[i] * c(f"__m{i}") for i in range(k)), F.lit(0.0))
    return g.select(
        "portfolio_id", alpha.alias("alpha_daily"), (alpha * TRADING_DAYS).alias("alpha_annualised"),
        F.coalesce(explained / nz("__vy"), F.lit(0.0)).alias("r_squared"), *[b for b in beta])


def return_attribution(daily: DataFrame, factors: DataFrame, names: list[str], regression: DataFrame) -> DataFrame:
    """Daily contribution of every factor and the residual."""
    df = daily.select(*PD, "net").join(factors.select("date", *names), "date").fillna(0.0, names).join(regression, "portfolio_id")
    parts = {f"contrib_{x}": c(x) * c(f"beta_{x}") for x in names}
    df = df.withColumns(parts).withColumn("total_factor", sum((c(p) for p in parts), F.lit(0.0)))
    return df.select(*PD, *parts, "total_factor", (c("net") - c("alpha_daily") - c("total_factor")).alias("residual"), c("net").alias("portfolio_ret"))


def tearsheet(metrics: DataFrame, rolling: DataFrame) -> DataFrame:
    r = rolling.groupBy("portfolio_id").agg(
        F.avg("rolling_sharpe").alias("avg_rolling_sharpe"), F.min("rolling_sharpe").alias("min_rolling_sharpe"),
        F.avg(F.coalesce(c("rolling_sharpe") > 0, F.lit(False)).cast("double")).alias("pct_positive_rolling"))
    return metrics.join(r, "portfolio_id", "left")


# -- stress ----------------------------------------------------------------------------

# Stress scenarios (cost factor, liquidity factor, first and last day).
SCENARIOS = [
    ("2x Transaction Cost", 2.0, 1.0, None, None),
    ("30% Liquidity Reduction", 1.0, 0.7, None, None),
    ("2008 Crash Replay", 1.0, 1.0, "2008-01-01", "2009-03-31"),
    ("2020 Crash Replay", 1.0, 1.0, "2020-02-01", "2020-05-31"),
]


def stress_tests(
    weights: DataFrame, returns: DataFrame, cal: DataFrame, exposure: DataFrame | None, adv: DataFrame | None,
    scenarios=SCENARIOS, cfg: Config = Config(capital=100_000.0), floor: float = 0.8,
) -> DataFrame:
    """Sharpe of every scenario, without volatility targeting.

    The scenarios differ in scalars only, so one backtest serves all: its daily turnover
    and impact are rescaled per scenario.  Fewer than 30 days or no variation give 0.
    """
    base = stage(run(weights, returns, cal, exposure, adv, replace(cfg, vol_targeting=False)), "stress")
    rows = F.array(*[F.struct(
        F.lit(n).alias("scenario"), F.lit(cm).alias("cm"), F.lit(am).alias("am"),
        F.lit(s).cast("date").alias("s"), F.lit(e).cast("date").alias("e")) for n, cm, am, s, e in scenarios])
    df = base.withColumn("x", F.explode(rows))
    net = c("gross") - c("fixed_cost") * c("x.cm") - c("impact_cost") / F.pow(c("x.am"), cfg.impact_power)
    inside = c("x.s").isNull() | c("date").between(c("x.s"), c("x.e"))
    kept = F.when(inside, net)
    sd = F.stddev_samp(kept)
    sharpe = F.when((F.count(kept) >= 30) & (sd > 0), F.avg(kept) / nz(sd) * ROOT).otherwise(0.0)
    return df.groupBy("portfolio_id", c("x.scenario").alias("scenario")).agg(
        F.count(kept).alias("n_days"), sharpe.alias("sharpe")).withColumn("resilient", c("sharpe") >= floor)


def high_vol_regime(weights: DataFrame, returns: DataFrame, cal: DataFrame, q: float = 0.9, min_days: int = 31) -> DataFrame:
    """Sharpe on days whose 20-day deviation exceeds its own 90 % quantile."""
    held = holdings(weights, cal, None, 1)
    fr = Frames(by_portfolio())
    gross = gross_returns(held, returns, daily_grid(weights, cal))
    # frames that hold the same returns in another order differ in the last bits: round, so ties are ties
    sd20 = F.round(fr.roll(F.stddev_samp, "gross", 20), 12)
    df = stage(fr.add(gross, {"sd20": sd20}).select(*PD, "gross", "sd20"), "vol")
    cut = quantiles(df, ["portfolio_id"], "sd20", {"cut": q})
    hot = df.join(cut, "portfolio_id").where(c("sd20") > c("cut"))
    sd = F.stddev_samp("gross")
    return hot.groupBy("portfolio_id").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.when((F.count(F.lit(1)) >= min_days) & (sd > 0), F.avg("gross") / nz(sd) * ROOT).otherwise(0.0).alias("sharpe"))
