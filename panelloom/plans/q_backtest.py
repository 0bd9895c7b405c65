"""Queries: backtest."""

from pyspark.sql import functions as F

from panelloom.functions import calendar, stage, tidy
from panelloom.operators import alpha, backtest, universe
from panelloom.plans.oracle import fin, r
from panelloom.plans.registry import query
from panelloom.sources.tables import Tables, staged

c = F.col
PD = "portfolio_id:i date:d"
CFG = backtest.Config(capital=100_000.0)
CRASH = [("2x Transaction Cost", 2.0, 1.0, None, None), ("30% Liquidity Reduction", 1.0, 0.7, None, None),
         ("1996 window", 1.0, 1.0, "1996-01-01", "1997-03-31"), ("2000 window", 1.0, 1.0, "2000-02-01", "2000-05-31")]


def exposure(t):
    v = c("close")
    return t.vix().select("date", F.when(v < 22, 1.0).when(v <= 30, 0.8).otherwise(0.6).alias("exposure"))


@staged
def backtest_daily(t: Tables):
    return backtest.run(t.weights(), t.close_returns(), calendar(t.panel()), exposure(t), universe.traded_value(t.panel(), names=t.weights()), CFG)


@query("portfolio_schedule", fin("portfolio_id:i rebal_date:d ticker:k weight", "SELECT * FROM weights"))
def _(t):
    return t.weights()


@query("backtest_holdings", fin(f"{PD} ticker:k weight", "SELECT portfolio_id, date, ticker, weight FROM held"))
def _(t):
    return backtest.holdings(t.weights(), calendar(t.panel()), exposure(t)).drop("idx")


@query("backtest_gross_return", fin(f"{PD} gross", "SELECT portfolio_id, date, gross FROM gross0"))
def _(t):
    cal = calendar(t.panel())
    held = backtest.holdings(t.weights(), cal, exposure(t))
    return backtest.gross_returns(held, t.close_returns(), backtest.daily_grid(t.weights(), cal)).drop("idx")


@query("backtest_vol_scalar", fin(f"{PD} gross scalar", "SELECT portfolio_id, date, gross, scalar FROM scal"))
def _(t):
    cal = calendar(t.panel())
    held = backtest.holdings(t.weights(), cal, exposure(t))
    gross = backtest.gross_returns(held, t.close_returns(), backtest.daily_grid(t.weights(), cal))
    return backtest.vol_scalar(gross).drop("idx")


@query("backtest_daily", fin(f"{PD} gross scalar turnover fixed_cost impact_cost net equity:2 drawdown", "SELECT * FROM bt"))
def _(t):
    cal = calendar(t.panel())
    return backtest.run(t.weights(), t.close_returns(), cal, exposure(t), universe.traded_value(t.panel(), names=t.weights()), CFG).withColumn("equity", tidy("equity", 2))


SUM = """SELECT *, cagr / nullif(abs(max_drawdown), 0) AS calmar_ratio FROM (SELECT portfolio_id,
    pow(arg_max(equity, date) / arg_min(equity, date) FILTER (date >= f), 252.0 / count(*) FILTER (date >= f)) - 1 AS cagr,
    stddev_samp(net) * sqrt(252.0) AS ann_vol,
    avg(net) FILTER (date >= f) / stddev_samp(net) FILTER (date >= f) * sqrt(252.0) AS sharpe_ratio, min(drawdown) AS max_drawdown,
    arg_max(equity, date) / arg_min(equity, date) - 1 AS total_return, arg_max(equity, date) AS final_equity, avg(turnover) * 252 AS ann_turnover,
    sum(fixed_cost) * 1e4 / (date_diff('day', min(date), max(date)) / 365.25::DOUBLE) AS ann_fixed_cost_bp,
    sum(impact_cost) * 1e4 / (date_diff('day', min(date), max(date)) / 365.25::DOUBLE) AS ann_impact_cost_bp
    FROM act GROUP BY portfolio_id)"""
ACT = {"act": "SELECT *, min(CASE WHEN abs(net) > 1e-9 THEN date END) OVER (PARTITION BY portfolio_id) AS f FROM bt"}


@query("backtest_summary", fin("portfolio_id:i cagr ann_vol sharpe_ratio max_drawdown calmar_ratio total_return final_equity:2 ann_turnover ann_fixed_cost_bp:4 ann_impact_cost_bp:4", SUM, ACT))
def _(t):
    s = backtest.summary(backtest_daily(t))
    return s.withColumns({"final_equity": tidy("final_equity", 2), "ann_fixed_cost_bp": tidy("ann_fixed_cost_bp", 4), "ann_impact_cost_bp": tidy("ann_impact_cost_bp", 4)})


FULL = """SELECT *, cagr / nullif(abs(max_drawdown), 0) AS calmar_ratio FROM (SELECT portfolio_id,
    pow(arg_max(equity, act.date) / arg_min(equity, act.date) FILTER (act.date >= f), 252.0 / count(*) FILTER (act.date >= f)) - 1 AS cagr,
    stddev_samp(net) FILTER (act.date >= f) * sqrt(252.0) AS ann_vol,
    (avg(net) FILTER (act.date >= f) - (pow(1.065::DOUBLE, 1 / 252.0) - 1)) / stddev_samp(net) FILTER (act.date >= f) * sqrt(252.0) AS sharpe_ratio,
    (avg(net) FILTER (act.date >= f) * 252 - 0.065) / (stddev_samp(net) FILTER (act.date >= f AND net < 0) * sqrt(252.0)) AS sortino_ratio,
    avg(net - coalesce(mkt_ret, 0)) FILTER (act.date >= f) / stddev_samp(net - coalesce(mkt_ret, 0)) FILTER (act.date >= f) * sqrt(252.0) AS information_ratio,
    min(drawdown) AS max_drawdown, arg_max(equity, act.date) / arg_min(equity, act.date) - 1 AS total_return, arg_max(equity, act.date) AS final_equity,
    avg(turnover) * 252 AS ann_turnover, sum(fixed_cost) * 1e4 / (count(*) / 252.0) AS ann_fixed_cost_bp, sum(impact_cost) * 1e4 / (count(*) / 252.0) AS ann_impact_cost_bp
    FROM act LEFT JOIN market ON act.date = market.date GROUP BY portfolio_id)"""
FULL_SPEC = "portfolio_id:i cagr ann_vol sharpe_ratio sortino_ratio information_ratio max_drawdown calmar_ratio total_return final_equity:2 ann_turnover ann_fixed_cost_bp:4 ann_impact_cost_bp:4"


def full(t):
    s = backtest.full_metrics(backtest_daily(t), t.market())
    return s.withColumns({"final_equity": tidy("final_equity", 2), "ann_fixed_cost_bp": tidy("ann_fixed_cost_bp", 4), "ann_impact_cost_bp": tidy("ann_impact_cost_bp", 4)})


@query("backtest_full_metrics", fin(FULL_SPEC, FULL, ACT))
def _(t):
    return full(t)


RP = "OVER (PARTITION BY portfolio_id ORDER BY date ROWS 62 PRECEDING)"
ROLL = {"ro0": f"""SELECT *, {r('avg', 'net', 63, 21, part='portfolio_id')} AS m, {r('stddev_samp', 'net', 63, 21, part='portfolio_id')} AS s,
        CASE WHEN count(CASE WHEN net < 0 THEN 1 END) {RP} > 1 THEN stddev_samp(CASE WHEN net < 0 THEN net END) {RP} ELSE 1e-8 END AS dn, row_number() OVER (PARTITION BY portfolio_id ORDER BY date) AS rn FROM bt""",
        "ro": """SELECT *, (m - (pow(1.065::DOUBLE, 1 / 252.0) - 1)) / nullif(s, 0) * sqrt(252.0) AS rolling_sharpe, nullif(s, 0) * sqrt(252.0) AS rolling_vol,
        CASE WHEN m IS NOT NULL AND dn > 0 THEN (m * 252 - 0.065) / (dn * sqrt(252.0)) END AS rolling_sortino FROM ro0""",
        "rdd": """SELECT portfolio_id, rn, min(eq / mx - 1) AS rolling_max_dd FROM (SELECT *, max(eq) OVER (PARTITION BY portfolio_id, rn ORDER BY k) AS mx FROM (
            SELECT a.portfolio_id, a.rn, b.rn AS k, product(1 + b.net) OVER (PARTITION BY a.portfolio_id, a.rn ORDER BY b.rn) AS eq
            FROM ro0 a JOIN ro0 b ON a.portfolio_id = b.portfolio_id AND b.rn BETWEEN a.rn - 62 AND a.rn)) GROUP BY 1, 2"""}


@query("backtest_rolling_metrics", fin(f"{PD} rolling_sharpe rolling_vol rolling_sortino rolling_max_dd",
    "SELECT ro.*, CASE WHEN m IS NOT NULL THEN rolling_max_dd END AS rolling_max_dd FROM ro JOIN rdd USING (portfolio_id, rn)", ROLL))
def _(t):
    return backtest.rolling_metrics(backtest_daily(t))


MONTH = "SELECT portfolio_id, date_trunc('month', date)::DATE AS month, product(1 + net) - 1 AS monthly_return FROM bt GROUP BY 1, 2"


@query("backtest_monthly_returns", fin("portfolio_id:i month:d monthly_return", MONTH))
def _(t):
    return backtest.monthly_returns(backtest_daily(t))


@query("backtest_month_pivot", fin("portfolio_id:i year:i " + " ".join(f"m{k:02d}" for k in range(1, 13)),
    "SELECT portfolio_id, year(month) AS year, " + ", ".join(f"max(monthly_return) FILTER (month(month) = {k}) AS m{k:02d}" for k in range(1, 13))
    + f" FROM ({MONTH}) GROUP BY 1, 2"))
def _(t):
    return backtest.month_pivot(backtest.monthly_returns(backtest_daily(t)))


@query("backtest_exposure_panel", fin(f"{PD} ticker:k holding:2", "SELECT portfolio_id, h.date, h.ticker, weight * equity AS holding FROM held2 h JOIN bt USING (portfolio_id, date)"))
def _(t):
    held = backtest.scaled_holdings(t.weights(), t.close_returns(), calendar(t.panel()), exposure(t))
    return backtest.exposure_panel(held, backtest_daily(t)).withColumn("holding", tidy("holding", 2))


@query("backtest_exposure_concentration", fin(f"{PD} gross_exposure net_exposure hhi effective_n", """
    SELECT g.portfolio_id, g.date, coalesce(a, 0) AS gross_exposure, coalesce(n, 0) AS net_exposure, coalesce(q / (n * n), 0) AS hhi, coalesce(1 / (q / (n * n)), 0) AS effective_n
    FROM grid g LEFT JOIN (SELECT portfolio_id, date, sum(abs(weight)) AS a, sum(weight) AS n, sum(weight * weight) AS q FROM held GROUP BY 1, 2) x USING (portfolio_id, date)"""))
def _(t):
    cal = calendar(t.panel())
    return backtest.exposure_series(backtest.holdings(t.weights(), cal, exposure(t)), backtest.daily_grid(t.weights(), cal).drop("idx"))


def factors(t):
    return t.factor_returns().groupBy("date").agg(
        F.max(F.when(c("factor") == "ASIA", c("ret"))).alias("asia"), F.max(F.when(c("factor") == "EUROPE", c("ret"))).alias("europe"))


REG = {"fx": "SELECT portfolio_id, bt.date, net, coalesce(asia, 0) AS asia, coalesce(europe, 0) AS europe FROM bt JOIN fwide USING (date)",
       "mo": """SELECT portfolio_id, count(*) AS n, avg(net) AS my, var_pop(net) AS vy, avg(asia) AS m1, avg(europe) AS m2, covar_pop(asia, net) AS y1, covar_pop(europe, net) AS y2,
            var_pop(asia) AS c11, var_pop(europe) AS c22, covar_pop(asia, europe) AS c12 FROM fx GROUP BY 1 HAVING count(*) >= 30""",
       "rg": """SELECT *, my - beta_asia * m1 - beta_europe * m2 AS alpha_daily, (beta_asia * y1 + beta_europe * y2) / vy AS r_squared FROM (
            SELECT *, (c22 * y1 - c12 * y2) / (c11 * c22 - c12 * c12) AS beta_asia, (c11 * y2 - c12 * y1) / (c11 * c22 - c12 * c12) AS beta_europe FROM mo)"""}


@query("backtest_factor_regression", fin("portfolio_id:i alpha_daily alpha_annualised r_squared beta_asia beta_europe", "SELECT *, alpha_daily * 252 AS alpha_annualised FROM rg", REG))
def _(t):
    return backtest.factor_regression(backtest_daily(t), factors(t), ["asia", "europe"])


@query("backtest_return_attribution", fin(f"{PD} contrib_asia contrib_europe total_factor residual portfolio_ret", """
    SELECT portfolio_id, date, asia * beta_asia AS contrib_asia, europe * beta_europe AS contrib_europe, asia * beta_asia + europe * beta_europe AS total_factor,
      net - alpha_daily - asia * beta_asia - europe * beta_europe AS residual, net AS portfolio_ret FROM fx JOIN rg USING (portfolio_id)""", REG))
def _(t):
    daily, f = backtest_daily(t), factors(t)
    return backtest.return_attribution(daily, f, ["asia", "europe"], backtest.factor_regression(daily, f, ["asia", "europe"]))


@query("backtest_tearsheet", fin(FULL_SPEC + " avg_rolling_sharpe min_rolling_sharpe pct_positive_rolling", f"""
    SELECT * FROM ({FULL}) JOIN (SELECT portfolio_id, avg(rolling_sharpe) AS avg_rolling_sharpe, min(rolling_sharpe) AS min_rolling_sharpe,
    avg(coalesce(rolling_sharpe > 0, false)::INT) AS pct_positive_rolling FROM ro GROUP BY 1) USING (portfolio_id)""", ACT | ROLL))
def _(t):
    return backtest.tearsheet(full(t), backtest.rolling_metrics(backtest_daily(t)))


def _scen(n, cm, am, s, e):
    return f"('{n}', {cm}::DOUBLE, {am}::DOUBLE, {f'DATE {s!r}' if s else 'NULL::DATE'}, {f'DATE {e!r}' if e else 'NULL::DATE'})"


STRESS = {
    "trd0": """SELECT coalesce(a.portfolio_id, b.portfolio_id) AS portfolio_id, coalesce(a.idx, b.idx + 1) AS idx, coalesce(a.ticker, b.ticker) AS ticker,
        abs(coalesce(a.weight, 0) - coalesce(b.weight, 0)) AS trade FROM held a FULL JOIN held b ON a.portfolio_id = b.portfolio_id AND a.ticker = b.ticker AND a.idx = b.idx + 1""",
    "scen": "SELECT * FROM (VALUES " + ", ".join(_scen(*x) for x in CRASH) + ") v(scenario, cm, am, s, e)",
    "sc": """SELECT scenario, portfolio_id, t.date, sum(trade) * 0.0015 * cm AS fixed_cost, sum(0.1 * pow(trade * 1e5 / (greatest(coalesce(adv, 1.0), 1.0) * am), 2)) AS impact_cost
        FROM (SELECT trd0.*, date FROM trd0 JOIN cal USING (idx)) t ASOF LEFT JOIN adv ON t.ticker = adv.ticker AND t.date >= adv.date CROSS JOIN scen GROUP BY scenario, cm, portfolio_id, t.date""",
    "sn": """SELECT g.portfolio_id, scen.scenario, g.date, gross - coalesce(fixed_cost, 0) - coalesce(impact_cost, 0) AS net FROM gross0 g CROSS JOIN scen
        LEFT JOIN sc ON sc.scenario = scen.scenario AND sc.portfolio_id = g.portfolio_id AND sc.date = g.date WHERE s IS NULL OR g.date BETWEEN s AND e""",
}


@query("backtest_stress_scenarios", fin("portfolio_id:i scenario:k n_days:i sharpe resilient:k", """
    SELECT *, sharpe >= 0.8 AS resilient FROM (SELECT portfolio_id, scenario, count(*) AS n_days,
      CASE WHEN count(*) >= 30 AND stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) * sqrt(252.0) ELSE 0 END AS sharpe FROM sn GROUP BY 1, 2)""", STRESS))
def _(t):
    return backtest.stress_tests(t.weights(), t.close_returns(), calendar(t.panel()), exposure(t), universe.traded_value(t.panel(), names=t.weights()), CRASH)


@query("backtest_high_vol_regime", fin("portfolio_id:i n_days:i sharpe", f"""
    SELECT portfolio_id, count(*) AS n_days, CASE WHEN count(*) > 30 THEN avg(gross) / stddev_samp(gross) * sqrt(252.0) ELSE 0 END AS sharpe FROM (
      SELECT *, quantile_cont(sd, 0.9) OVER (PARTITION BY portfolio_id) AS cut FROM hv) WHERE sd > cut GROUP BY 1""", {
    "hv": f"SELECT *, {r('stddev_samp', 'gross', 20, part='portfolio_id')} AS sd FROM hv0",
    "hv0": """SELECT g.portfolio_id, g.date, coalesce(x, 0) AS gross FROM grid g LEFT JOIN (SELECT w.portfolio_id, n.date, sum(weight * ret) AS x FROM weights w JOIN sp USING (portfolio_id, rebal_date)
        JOIN cal d ON d.idx BETWEEN s AND e JOIN cal n ON n.idx = d.idx + 1 JOIN rets r ON r.date = n.date AND r.ticker = w.ticker AND ret IS NOT NULL GROUP BY 1, 2) q USING (portfolio_id, date)"""}))
def _(t):
    return backtest.high_vol_regime(t.weights(), t.close_returns(), calendar(t.panel()))


@query("backtest_decision_matrix")
def _(t):
    """Eight threshold checks over evaluation, backtest, sub-periods and stress, with the verdict."""
    ic = stage(alpha.daily_ic(t.scores(), t.panel(), [21], 5, calendar_shift=False), "ic")
    daily = backtest_daily(t)
    stress = backtest.stress_tests(t.weights(), t.close_returns(), calendar(t.panel()), exposure(t), universe.traded_value(t.panel(), names=t.weights()), CRASH)
    met = stress.groupBy("portfolio_id").agg(F.min("resilient").alias("stress_ok"))
    periods = alpha.sub_period_ic(ic, [("early", "1995-01-01", "1996-12-31"), ("middle", "1997-01-01", "1999-12-31"), ("late", "2000-01-01", "2001-12-31")])
    stable = periods.agg((F.sum(c("profitable").cast("int")) >= 2).alias("periods_ok"))
    one = F.broadcast(alpha.ic_stats(ic).join(stable))
    m = backtest.summary(daily).join(met, "portfolio_id").join(one)
    drag = c("ann_fixed_cost_bp") + c("ann_impact_cost_bp")
    checks = {
        "ic_mean_ok": c("ic_mean") > 0.035, "ic_tstat_ok": c("ic_tstat") > 2.0, "sharpe_ok": c("sharpe_ratio") > 1.5,
        "turnover_ok": c("ann_turnover") * 100 < 400, "cost_ok": (drag > 0) & (drag < 500), "periods_ok": c("periods_ok"),
        "stress_ok": c("stress_ok"), "drawdown_ok": F.abs("max_drawdown") < 0.20,
    }
    return m.select("portfolio_id", *alpha.verdict(checks))


@query("research_run_monthly")
def _(t):
    """The end-to-end run from raw rows to monthly returns."""
    from panelloom.plans.flagship import research_run

    return research_run(t, [5, 10])["monthly"]
