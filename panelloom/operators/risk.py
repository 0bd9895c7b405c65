"""Risk measures on portfolio return series ``(portfolio_id, date, net)`` and weight tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import Frames, asof_join, calendar, nz, quantiles, with_stats
from panelloom.operators.portfolio import KEYS

c = F.col
# Normal quantiles of the supported confidence levels.
NORMAL_QUANTILE = {0.95: 1.6448536269514722, 0.99: 2.3263478740408408}


def historical_var(series: DataFrame, levels=(0.95, 0.99), keys=("portfolio_id",), ret: str = "net") -> DataFrame:
    """Value at risk and expected shortfall from the empirical quantile, floored at 0."""
    keys = list(keys)
    cuts = quantiles(series, keys, ret, {f"q{i}": 1.0 - lv for i, lv in enumerate(levels)})
    df = series.join(cuts, keys)
    aggs = []
    for i, lv in enumerate(levels):
        tag = int(round(lv * 100))
        q = c(f"q{i}")
        aggs += [F.greatest(F.lit(0.0), -F.max(q)).alias(f"var_{tag}"),
                 F.greatest(F.lit(0.0), -F.avg(F.when(c(ret) <= q, c(ret)))).alias(f"cvar_{tag}")]
    return df.groupBy(*keys).agg(*aggs)


def parametric_var(series: DataFrame, level: float = 0.95, cornish_fisher: bool = True, keys=("portfolio_id",), ret: str = "net") -> DataFrame:
    """Normal VaR, the quantile adjusted for skewness and excess kurtosis beyond 30 rows."""
    g = series.groupBy(*keys).agg(
        F.count(ret).alias("n"), F.avg(ret).alias("m"), F.stddev_samp(ret).alias("sd"),
        F.skewness(ret).alias("sk"), F.kurtosis(ret).alias("kt"))
    z0 = NORMAL_QUANTILE[level]
    adj = (F.lit(z0) + (z0**2 - 1) * c("sk") / 6.0 + (z0**3 - 3 * z0) * c("kt") / 24.0
           - (2 * z0**3 - 5 * z0) * c("sk") * c("sk") / 36.0)
    g = g.withColumn("z", F.when((c("n") > 30) & F.lit(cornish_fisher) & c("sk").isNotNull(), adj).otherwise(z0))
    pdf = F.exp(-c("z") * c("z") / 2.0) / math.sqrt(2 * math.pi)
    ok = c("sd") > 0
    return g.select(
        *keys, "z", F.when(ok, F.greatest(F.lit(0.0), c("z") * c("sd") - c("m"))).otherwise(0.0).alias("var"),
        F.when(ok, F.greatest(F.lit(0.0), c("sd") * pdf / (1.0 - level) - c("m"))).otherwise(0.0).alias("cvar"))


def normal_draws(*parts: Column) -> Column:
    """A standard normal draw that depends on nothing but ``parts`` (a seed, keys, a counter).

    The hash of the joined parts gives two numbers of 52 bits, which the polar form turns into
    a draw: the same on every partitioning, after every retry, and in any other engine."""
    h = F.md5(F.concat_ws(":", *[x.cast("string") for x in parts]))
    unit = lambda at: (F.conv(F.substring(h, at, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    return F.sqrt(-2.0 * F.log(unit(1))) * F.cos(2.0 * math.pi * unit(14))


def monte_carlo_var(series: DataFrame, level: float = 0.95, n: int = 10_000, seed: int = 42, ret: str = "net") -> DataFrame:
    """VaR of ``n`` normal draws with the series' mean and deviation; draw ``i`` of a portfolio
    is fixed by the seed, the portfolio and ``i``."""
    g = series.groupBy("portfolio_id").agg(F.avg(ret).alias("m"), F.stddev_samp(ret).alias("sd"))
    draws = g.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n)))).select(
        "portfolio_id", (c("m") + c("sd") * normal_draws(F.lit(seed), c("portfolio_id"), c("i"))).alias(ret))
    return historical_var(draws, (level,), ret=ret)


def days_to_liquidate(weights: DataFrame, adv: DataFrame, value: float = 1e7, participation: float = 0.10) -> DataFrame:
    """Days to sell each position at a share of its traded value (unknown: 1e6)."""
    df = weights.join(adv, ["rebal_date", "ticker"], "left")
    dtl = c("weight") * value / nz(F.coalesce("adv", F.lit(1e6)) * participation)
    return df.select(*KEYS, "ticker", F.coalesce(dtl, F.lit(0.0)).alias("days"))


def liquidity_var(dtl: DataFrame, base_var: DataFrame, horizon: float = 10.0) -> DataFrame:
    """95 % quantile of the days and the VaR with its liquidation penalty (``base_var``: portfolio_id, var)."""
    q = quantiles(dtl, KEYS, "days", {"days_95": 0.95}).join(base_var, "portfolio_id")
    return q.select(*KEYS, "days_95", (c("var") + 0.002 * F.greatest(F.lit(1.0), c("days_95") / horizon)).alias("lvar"))


def concentration(weights: DataFrame) -> DataFrame:
    """Herfindahl index, effective number of names and shares of the largest 5 and 10."""
    w = Window.partitionBy(*KEYS).orderBy(c("weight").desc(), "ticker")
    df = with_stats(weights, KEYS, __s=F.sum("weight")).withColumn("w", c("weight") / nz("__s")).withColumn("rk", F.row_number().over(w))
    hhi = F.sum(c("w") * c("w"))
    top = lambda k: F.coalesce(F.sum(F.when(c("rk") <= k, c("w"))), F.lit(0.0))
    return df.groupBy(*KEYS).agg(
        F.coalesce(hhi, F.lit(0.0)).alias("hhi"), F.coalesce(F.lit(1.0) / nz(hhi), F.lit(0.0)).alias("effective_n"),
        top(5).alias("top_5"), top(10).alias("top_10"), F.max("w").alias("max_weight"))


def limit_audit(
    weights: DataFrame, sectors: DataFrame | None = None, max_position: float = 0.10, max_hhi: float = 0.15,
    min_effective: float = 15.0, max_sector: float = 0.30,
) -> DataFrame:
    """Position, concentration and sector limits; ``passed`` when all hold."""
    r4 = lambda x, p: F.floor(x * 10.0**p + 0.5) / 10.0**p
    df = concentration(weights).select(
        *KEYS, (c("max_weight") <= max_position).alias("single_position_limit"), (r4(c("hhi"), 4) <= max_hhi).alias("hhi_limit"),
        (r4(c("effective_n"), 2) >= min_effective).alias("effective_n_limit"))
    checks = ["single_position_limit", "hhi_limit", "effective_n_limit"]
    if sectors is not None:
        top = sector_exposure(weights, sectors, normalized=True).groupBy(*KEYS).agg(
            (F.max("portfolio_weight") <= max_sector).alias("sector_limit"))
        df, checks = df.join(top, KEYS), checks + ["sector_limit"]
    passed = c(checks[0])
    for k in checks[1:]:
        passed = passed & c(k)
    return df.withColumn("passed", passed)


def tail_metrics(series: DataFrame, q: float = 0.05, ret: str = "net") -> DataFrame:
    """Skewness, excess kurtosis and expected tail loss; zero below 30 rows."""
    cut = quantiles(series, ["portfolio_id"], ret, {"cut": q})
    g = series.join(cut, "portfolio_id").groupBy("portfolio_id").agg(
        F.count(ret).alias("n"), F.skewness(ret).alias("sk"), F.kurtosis(ret).alias("kt"),
        F.avg(F.when(c(ret) <= c("cut"), c(ret))).alias("tail"))
    v = lambda x: F.when(c("n") >= 30, F.coalesce(x, F.lit(0.0))).otherwise(0.0)
    return g.select("portfolio_id", v(c("sk")).alias("skewness"), v(c("kt")).alias("kurtosis"),
                    v(F.greatest(F.lit(0.0), -c("tail"))).alias("etl_95"))


def exceedances(series: DataFrame, q: float = 0.05, ret: str = "net") -> DataFrame:
    """Losses above their own (1 - q) quantile, as excess over it."""
    losses = series.where(c(ret) < 0).select("portfolio_id", (-c(ret)).alias("loss"))
    cut = quantiles(losses, ["portfolio_id"], "loss", {"cut": 1.0 - q})
    return losses.join(cut, "portfolio_id").where(c("loss") > c("cut")).select("portfolio_id", (c("loss") - c("cut")).alias("excess"))


def tail_index(series: DataFrame, q: float = 0.05, ret: str = "net", min_count: int = 11) -> DataFrame:
    """Shape of the generalised Pareto tail by profile likelihood over one parameter.

    Only exceedances of one daily series reach a group: a twentieth of its loss days.
    """

    def fit(pdf):
        import numpy as np
        import pandas as pd

        x = pdf["excess"].to_numpy()
        shape = 0.0
        if len(x) >= min_count:
            def nll(t):  # t = shape / scale, must keep 1 + t x positive
                k = np.mean(np.log1p(t * x))
                return np.inf if k / t <= 0 else np.log(k / t) + k + 1

            low, high = -1 / x.max() * (1 - 1e-6), 50 / x.mean()
            grid = np.unique(np.concatenate([np.linspace(low, -1e-6 / x.mean(), 200), np.geomspace(1e-6 / x.mean(), high, 200)]))
            best = min(range(len(grid)), key=lambda i: nll(grid[i]))
            a, b = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
            for _ in range(80):
                m1, m2 = b - (b - a) * 0.618, a + (b - a) * 0.618
                a, b = (a, m2) if nll(m1) < nll(m2) else (m1, b)
            shape = float(np.mean(np.log1p((a + b) / 2 * x)))
        return pd.DataFrame({"portfolio_id": [pdf["portfolio_id"].iloc[0]], "n_exceedances": [len(x)], "tail_index": [shape]})

    return exceedances(series, q, ret).groupBy("portfolio_id").applyInPandas(
        fit, "portfolio_id int, n_exceedances int, tail_index double")


def average_correlation(returns: DataFrame, panel: DataFrame) -> DataFrame:
    """Mean pairwise correlation of all instruments, absent days counting as zero return.

    No pair is formed: the variance of the sum of standardised returns is the sum of all
    correlations, so one sum per instrument and one per day are enough.
    """
    n = calendar(panel).agg(F.max("idx")).first()[0]
    t = float(n)
    stats = returns.groupBy("ticker").agg(F.sum("ret").alias("s"), F.sum(c("ret") * c("ret")).alias("q"))
    stats = stats.withColumn("sd", F.sqrt((c("q") - c("s") * c("s") / t) / (t - 1.0))).where("sd > 0")
    scaled = returns.join(stats.select("ticker", "sd"), "ticker").groupBy("date").agg(F.sum(c("ret") / c("sd")).alias("z"))
    day = scaled.agg(F.sum("z").alias("z1"), F.sum(c("z") * c("z")).alias("z2"))
    names = stats.agg(F.count(F.lit(1)).cast("double").alias("k"))
    total = (c("z2") - c("z1") * c("z1") / t) / (t - 1.0)
    return day.join(names).select(
        c("k").cast("bigint").alias("n_names"),
        F.when(c("k") > 1, (total - c("k")) / nz(c("k") * (c("k") - 1.0))).alias("avg_pairwise_correlation"))


def correlation_structure(cov: DataFrame) -> DataFrame:
    """Per rebalance: mean correlation, variance shares of the first one and three components,
    condition number of the correlation matrix.  k is the portfolio's number of names."""

    def one(pdf):
        import numpy as np
        import pandas as pd

        m = pdf.pivot(index="i", columns="j", values="cov").sort_index().sort_index(axis=1).to_numpy()
        out = [0.0, 0.0, 0.0, 0.0]
        if len(m) >= 2 and np.diag(m).min() > 0:
            sd = np.sqrt(np.diag(m))
            corr = m / np.outer(sd, sd)
            ev = np.sort(np.linalg.eigvalsh(m))[::-1]
            out = [corr[np.triu_indices(len(m), 1)].mean(), ev[0] / ev.sum(), ev[:3].sum() / ev.sum(), np.linalg.cond(corr)]
        return pd.DataFrame([[pdf["portfolio_id"].iloc[0], pdf["rebal_date"].iloc[0], *map(float, out)]],
                            columns=["portfolio_id", "rebal_date", "avg_correlation", "top1_share", "top3_share", "condition_number"])

    return cov.groupBy(*KEYS).applyInPandas(
        one, "portfolio_id int, rebal_date date, avg_correlation double, top1_share double, top3_share double, condition_number double")


def sector_exposure(weights: DataFrame, sectors: DataFrame, benchmark: DataFrame | None = None, normalized: bool = False) -> DataFrame:
    """Sector weights and the bet against the benchmark; absent benchmark sectors weigh 0."""
    df = weights
    if normalized:
        df = with_stats(weights, KEYS, __s=F.sum("weight")).withColumn("weight", c("weight") / nz("__s"))
    df = df.join(sectors.select("ticker", "sector"), "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("Other")))
    g = df.groupBy(*KEYS, "sector").agg(F.sum("weight").alias("portfolio_weight"))
    if benchmark is None:
        return g.withColumn("benchmark_weight", F.lit(0.0)).withColumn("active_bet", c("portfolio_weight"))
    return g.join(benchmark, "sector", "left").select(
        *KEYS, "sector", "portfolio_weight", F.coalesce("benchmark_weight", F.lit(0.0)).alias("benchmark_weight"),
        (c("portfolio_weight") - F.coalesce("benchmark_weight", F.lit(0.0))).alias("active_bet"))


def country_exposure(weights: DataFrame, countries: DataFrame, default: str = "India") -> DataFrame:
    df = weights.join(countries.select("ticker", "country"), "ticker", "left")
    return df.groupBy(*KEYS, F.coalesce("country", F.lit(default)).alias("country")).agg(F.sum("weight").alias("weight"))


def factor_exposure(weights: DataFrame, betas: DataFrame) -> DataFrame:
    """Weighted factor betas over names that have any (``betas``: ticker, factor, beta)."""
    known = weights.join(betas.select("ticker").distinct(), "ticker", "left_semi")
    known = with_stats(known, KEYS, __s=F.sum("weight"))
    return known.join(betas, "ticker").groupBy(*KEYS, "factor").agg(
        F.sum(c("weight") / nz("__s") * F.coalesce("beta", F.lit(0.0))).alias("exposure"))


def risk_contribution(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """Marginal and percent contribution of every name to the portfolio's deviation."""
    w = with_stats(weights, KEYS, __s=F.sum("weight")).select(*KEYS, "ticker", (c("weight") / nz("__s")).alias("weight"))
    wj = w.select(*KEYS, c("ticker").alias("j"), c("weight").alias("wj"))
    m = cov.join(wj, KEYS + ["j"]).groupBy(*KEYS, c("i").alias("ticker")).agg(F.sum(c("cov") * c("wj")).alias("cw"))
    df = with_stats(w.join(m, KEYS + ["ticker"]), KEYS, __v=F.sum(c("weight") * c("cw")))
    sd = F.when(c("__v") > 0, F.sqrt("__v")).otherwise(1e-4)
    return df.select(*KEYS, "ticker", "weight", (c("cw") / sd).alias("mcr"), (c("weight") * c("cw") / (sd * sd)).alias("pcr"))


# Market shocks of past crises and of macro scenarios.
CRISES = {
    "2008_Global_Financial_Crisis": -0.55, "2011_US_Debt_Downgrade": -0.18, "2016_China_Devaluation": -0.15,
    "2020_COVID_Crash": -0.38, "2022_Rate_Hike_Bear_Market": -0.25, "2024_Global_Vol_Spike": -0.12,
}
SCENARIOS = {
    "Crude_Oil_Price_Spike_30pct": -0.12, "Interest_Rate_Hike_100bps": -0.10, "India_VIX_Regime_Spike_50pct": -0.15,
    "Global_Liquidity_Tightening": -0.20, "Stagflation_Environment": -0.25,
}


def shock_losses(weights: DataFrame, betas: DataFrame | None, shocks: dict[str, float], value: float = 1e7) -> DataFrame:
    """Currency loss of every shock times the portfolio's beta (unknown betas 1)."""
    df = weights.withColumn("beta", F.lit(1.0)) if betas is None else weights.join(
        betas, [x for x in ("rebal_date", "ticker") if x in betas.columns], "left").withColumn("beta", F.coalesce("beta", F.lit(1.0)))
    b = df.groupBy(*KEYS).agg(F.sum(c("weight") * c("beta")).alias("beta"))
    table = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("shock")) for k, v in shocks.items()]))
    return b.withColumn("s", table).select(*KEYS, c("s.name").alias("scenario"), (-c("s.shock") * c("beta") * value).alias("loss"))


# -- regimes ---------------------------------------------------------------------------

def regime_signal(index: DataFrame, vix: DataFrame | None = None) -> DataFrame:
    """Unsmoothed exposure of an index ``(symbol, date, close)``: trend, crash guard, volatility."""
    w = Window.partitionBy("symbol").orderBy("date")
    fr = Frames(w)
    df = fr.add(index.select("symbol", "date", "close"), {
        "__dma": fr.roll(F.avg, "close", 200, 100), "__ret": c("close") / nz(F.lag("close").over(w)) - 1.0})
    trend = F.when(c("close") >= c("__dma"), 1.0).otherwise(0.6)
    guard = F.when(F.coalesce(F.lag(c("__ret") < -0.025).over(w), F.lit(False)), 0.5).otherwise(1.0)
    scale = F.lit(1.0)
    if vix is not None:
        df = asof_join(df, vix.select("date", c("close").alias("__vix")), [])
        scale = F.when(c("__vix") < 22, 1.0).when(c("__vix") <= 30, 0.8).otherwise(0.6)
    return df.select("symbol", "date", "close", (trend * guard * scale).alias("raw"))


def smooth(signal: DataFrame, span: int = 5) -> DataFrame:
    """Exponentially weighted mean with bias correction.

    The frame reaches back until a row's weight is below 1e-17, whatever the span."""
    keep = 1.0 - 2.0 / (span + 1.0)
    reach = 1 if keep <= 0 else math.ceil(math.log(1e-17) / math.log(keep))
    frame = Window.partitionBy("symbol").orderBy("date").rowsBetween(-(reach - 1), 0)
    df = signal.withColumn("__a", F.collect_list("raw").over(frame))
    total = F.aggregate("__a", F.lit(0.0), lambda s, x: s * keep + x)
    return df.withColumn("smooth", total * (1.0 - keep) / (1.0 - F.pow(F.lit(keep), F.size("__a").cast("double")))).drop("__a")


def hysteresis(series: DataFrame, band: float = 0.10) -> DataFrame:
    """Keep the last accepted value until the input leaves its band.  One row per day and symbol."""

    def walk(pdf):
        pdf = pdf.sort_values("date")
        held, out = None, []
        for v in pdf["smooth"]:
            held = v if held is None or abs(v - held) > band else held
            out.append(held)
        return pdf[["symbol", "date"]].assign(exposure=out)

    return series.select("symbol", "date", "smooth").groupBy("symbol").applyInPandas(walk, "symbol string, date date, exposure double")


def regime_exposure(index: DataFrame, vix: DataFrame | None = None) -> DataFrame:
    return hysteresis(smooth(regime_signal(index, vix)))


def robustness(ic: DataFrame, daily: DataFrame, periods: list[tuple[str, str, str]]) -> DataFrame:
    """Per sub-period: mean IC, Sharpe and worst drawdown of each portfolio."""
    tag = F.explode(F.array_compact(F.array(*[
        F.when(c("date").between(F.lit(s).cast("date"), F.lit(e).cast("date")), F.lit(p)) for p, s, e in periods])))
    d = daily.withColumn("period", tag)
    w = Window.partitionBy("portfolio_id", "period").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__dd", c("equity") / nz(F.max("equity").over(w)) - 1.0)
    sd = F.stddev_samp("net")
    perf = d.groupBy("portfolio_id", "period").agg(
        F.when(sd > 0, F.avg("net") / nz(sd) * math.sqrt(252.0)).otherwise(0.0).alias("sharpe"), F.min("__dd").alias("max_dd"))
    mean = ic.withColumn("period", tag).groupBy("period").agg(F.avg("ic").alias("ic_mean"))
    out = perf.join(mean, "period", "left").select(
        "portfolio_id", "period", F.coalesce("ic_mean", F.lit(0.0)).alias("ic_mean"), "sharpe", "max_dd")
    return with_stats(out, ["portfolio_id"], profitable_periods=F.sum((c("sharpe") > 0).cast("bigint"))).withColumn(
        "mandate_met", c("profitable_periods") >= 2)


def regime_ic(ic: DataFrame, exposure: DataFrame, index: DataFrame) -> DataFrame:
    """Mean IC in bull (full exposure), bear and high-volatility markets."""
    fr = Frames(Window.partitionBy("symbol").orderBy("date"))
    w = Window.partitionBy("symbol").orderBy("date")
    ret = index.select("symbol", "date", (c("close") / nz(F.lag("close").over(w)) - 1.0).alias("__r"))
    vol = fr.add(ret, {"vol": fr.roll(F.stddev_samp, "__r", 20) * math.sqrt(252.0)}).select("symbol", "date", "vol")
    cut = quantiles(vol, ["symbol"], "vol", {"cut": 0.9})
    hot = vol.join(cut, "symbol").select("date", "vol", "cut")
    df = asof_join(asof_join(ic.select("date", "ic"), exposure.select("date", "exposure"), []), hot, [])
    bull = F.coalesce(F.abs(c("exposure") - 1.0) < 1e-9, F.lit(False))
    z = lambda cond: F.coalesce(F.avg(F.when(cond, c("ic"))), F.lit(0.0))
    return df.agg(z(bull).alias("bull_ic"), z(~bull).alias("bear_ic"), z(c("vol") > c("cut")).alias("highvol_ic"))


def drawdown_stop(daily: DataFrame, limit: float = 0.20) -> DataFrame:
    last = F.max_by("drawdown", "date")
    return daily.groupBy("portfolio_id").agg(last.alias("current_drawdown"), (last < -limit).alias("halt"))


def regime_adjust(weights: DataFrame, flags: DataFrame) -> DataFrame:
    """Halve in a bear market, halve again in high volatility (``flags``: date, bull, high_vol; latest known)."""
    df = asof_join(weights.withColumnRenamed("rebal_date", "date"), flags.select("date", "bull", "high_vol"), [])
    k = F.when(c("bull") == 0, 0.5).otherwise(1.0) * F.when(c("high_vol") == 1, 0.5).otherwise(1.0)
    return df.select("portfolio_id", c("date").alias("rebal_date"), "ticker", (c("weight") * k).alias("weight"))
