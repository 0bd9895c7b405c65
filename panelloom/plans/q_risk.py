"""Queries: portfolio construction, risk."""

import math

from pyspark.sql import functions as F

from panelloom.functions import calendar, tidy
from panelloom.operators import alpha, portfolio, risk, solvers, universe
from panelloom.plans.oracle import fin, r
from panelloom.plans.q_alpha import PERIODS, PERIOD_SQL, ROWSHIFT
from panelloom.plans.q_backtest import backtest_daily
from panelloom.plans.registry import query
from panelloom.sources.tables import Tables, staged

c = F.col
K = "portfolio_id:i rebal_date:d"
W = f"{K} ticker:k weight"


def adv_at(t):
    """Traded value of selected names on the rebalance date."""
    return universe.traded_value(t.panel(), names=t.weights()).withColumnRenamed("date", "rebal_date")


def betas(t):
    """Market beta, over its whole history, of every instrument that a portfolio holds."""
    held = t.weights().select("ticker").distinct()
    j = t.close_returns().join(held, "ticker", "left_semi").join(t.market(), "date")
    return j.groupBy("ticker").agg((F.covar_samp("ret", "mkt_ret") / F.nullif(F.var_samp("mkt_ret"), F.lit(0.0))).alias("beta"))


@staged
def cov_table(t: Tables):
    return solvers.covariance(t.weights(), t.close_returns(), t.panel())


AT = {"advr": "SELECT w.*, a.adv FROM weights w LEFT JOIN adv a ON a.date = w.rebal_date AND a.ticker = w.ticker",
      "betas": "SELECT ticker, covar_samp(ret, mkt_ret) / nullif(var_samp(mkt_ret), 0) AS beta FROM rets JOIN market USING (date) WHERE ret IS NOT NULL GROUP BY 1"}
P = "OVER (PARTITION BY portfolio_id, rebal_date)"


@query("portfolio_score_ranks", fin("date:d ticker:k score rank:i", """SELECT * FROM (SELECT date, ticker, score,
    row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS rank FROM scores)"""))
def _(t):
    return portfolio.score_ranks(t.scores())


# Selection with memory: a row for every name at every rebalance, age null unless it is held.
HYST = """SELECT portfolio_id, rebal_date, ticker, rank, age AS days_held FROM (
  WITH RECURSIVE hd AS (SELECT rebal_date, row_number() OVER (ORDER BY rebal_date) AS k FROM (SELECT DISTINCT rebal_date FROM weights)),
  hr AS (SELECT k, ticker, row_number() OVER (PARTITION BY k ORDER BY score DESC, ticker) AS rank FROM hd JOIN scores ON date = hd.rebal_date),
  ha AS (SELECT p.*, hd.k, hd.rebal_date, n.ticker, hr.rank FROM (VALUES (1, 5, 7), (2, 8, 11)) p(portfolio_id, n, buffer) CROSS JOIN hd
         CROSS JOIN (SELECT DISTINCT ticker FROM hr) n LEFT JOIN hr ON hr.k = hd.k AND hr.ticker = n.ticker),
  hs AS (SELECT portfolio_id, k, rebal_date, ticker, rank, CASE WHEN rank <= n THEN 21 END AS age FROM ha WHERE k = 1
    UNION ALL SELECT portfolio_id, k, rebal_date, ticker, rank, CASE WHEN stay THEN age + 21
        WHEN cand AND sum(cand::INT) OVER (PARTITION BY portfolio_id ORDER BY rank NULLS LAST, ticker ROWS UNBOUNDED PRECEDING) <= n - sum(stay::INT) OVER (PARTITION BY portfolio_id) THEN 21 END
      FROM (SELECT *, coalesce(NOT stay AND rank <= n, false) AS cand FROM (
        SELECT ha.*, hs.age, coalesce(hs.age IS NOT NULL AND NOT (ha.rank > buffer AND (hs.age >= 40 OR ha.rank > 15)), false) AS stay
        FROM hs JOIN ha ON ha.portfolio_id = hs.portfolio_id AND ha.ticker = hs.ticker AND ha.k = hs.k + 1)))
  SELECT * FROM hs WHERE age IS NOT NULL)"""
NOTRADE = """SELECT portfolio_id, rebal_date, ticker, weight FROM (
  WITH RECURSIVE nd AS (SELECT portfolio_id, rebal_date, row_number() OVER (PARTITION BY portfolio_id ORDER BY rebal_date) AS k FROM (SELECT DISTINCT portfolio_id, rebal_date FROM weights)),
  na AS (SELECT nd.portfolio_id, nd.k, nd.rebal_date, n.ticker, coalesce(v.weight, 0) AS asked, v.weight IS NOT NULL AS named
         FROM nd JOIN (SELECT DISTINCT portfolio_id, ticker FROM weights) n ON n.portfolio_id = nd.portfolio_id
         LEFT JOIN weights v ON v.portfolio_id = nd.portfolio_id AND v.rebal_date = nd.rebal_date AND v.ticker = n.ticker),
  ns AS (SELECT portfolio_id, k, rebal_date, ticker, asked::DOUBLE AS weight, named AS shown FROM na WHERE k = 1
    UNION ALL SELECT portfolio_id, k, rebal_date, ticker, CASE WHEN sum(x) OVER (PARTITION BY portfolio_id) > 0 THEN x / sum(x) OVER (PARTITION BY portfolio_id) ELSE x END, shown
      FROM (SELECT na.*, CASE WHEN abs(asked - ns.weight) > 0.15 THEN asked ELSE ns.weight END AS x, named OR ns.weight <> 0 AS shown
            FROM ns JOIN na ON na.portfolio_id = ns.portfolio_id AND na.ticker = ns.ticker AND na.k = ns.k + 1))
  SELECT * FROM ns WHERE shown)"""


@query("portfolio_hysteresis", fin(f"{K} ticker:k rank:i days_held:i", HYST))
def _(t):
    monthly = t.scores().join(t.weights().select(c("rebal_date").alias("date")).distinct(), "date", "left_semi")
    return portfolio.hysteresis_schedule(monthly, {1: 5, 2: 8}, min_hold=40, emergency_rank=15)


EW = {"e0": f"SELECT portfolio_id, rebal_date, ticker, 1.0::DOUBLE / count(*) {P} AS w, coalesce(adv, 0) * 0.05 / 1e5 AS cap FROM advr",
      "e1": "SELECT *, w > cap AS capped, CASE WHEN w > cap THEN cap ELSE w END AS w1 FROM e0",
      "e2": f"SELECT *, 1 - sum(w1) {P} AS rest, sum((NOT capped)::INT) {P} AS free, count(*) {P} AS n FROM e1",
      "e3": "SELECT *, CASE WHEN NOT capped AND rest > 0.001 AND free < n THEN w1 + rest / free ELSE w1 END AS w2 FROM e2",
      "ew": f"SELECT portfolio_id, rebal_date, ticker, CASE WHEN sum(w2) {P} > 0 THEN w2 / sum(w2) {P} ELSE w2 END AS weight FROM e3"}
SMALL = portfolio.Constraints(portfolio_value=1e5)


@query("portfolio_equal_weight", fin(W, "SELECT * FROM ew", AT | EW))
def _(t):
    return portfolio.equal_weight(t.weights(), adv_at(t), SMALL)


SN = {"s0": "SELECT w.*, coalesce(sector, 'Other') AS sector FROM weights w LEFT JOIN smap USING (ticker)",
      "s1": "SELECT s0.*, benchmark_weight AS b, sum(weight) OVER (PARTITION BY portfolio_id, rebal_date, s0.sector) AS sw FROM s0 LEFT JOIN sbench ON s0.sector = sbench.sector",
      "s2": "SELECT *, CASE WHEN b IS NOT NULL AND sw > 0 THEN weight * greatest(least(sw, b + 0.05::DOUBLE), b - 0.05::DOUBLE) / sw ELSE weight END AS w2 FROM s1",
      "sn": f"SELECT portfolio_id, rebal_date, ticker, w2 / sum(w2) {P} AS weight FROM s2"}


@query("portfolio_sector_neutral", fin(W, "SELECT * FROM sn", SN))
def _(t):
    return portfolio.sector_neutralize(t.weights(), t.sector_map(), t.sector_benchmark())


BT = {"b0": f"SELECT w.*, sum(weight * coalesce(beta, 1)) {P} AS pb FROM weights w LEFT JOIN betas USING (ticker)"} | AT


@query("portfolio_beta_target", fin(W, """SELECT portfolio_id, rebal_date, ticker, weight * CASE WHEN pb < 0.8 AND pb > 0 THEN 0.8 / pb WHEN pb > 1.2 THEN 1.2 / pb ELSE 1 END AS weight FROM b0""", BT))
def _(t):
    return portfolio.beta_target(t.weights(), betas(t))


def clip_sql(src: str, low: float, high: float, passes: int = 10) -> dict[str, str]:
    parts = {"c0": f"SELECT portfolio_id, rebal_date, ticker, weight AS w, false AS done FROM {src}"}
    for i in range(passes):
        parts[f"c{i}a"] = f"SELECT portfolio_id, rebal_date, ticker, done, CASE WHEN done THEN w ELSE greatest({low}, least({high}, w)) END AS x FROM c{i}"
        parts[f"c{i}b"] = f"SELECT *, sum(x) {P} AS s, x > {low} AND x < {high} AS inn, count(*) {P} AS n FROM c{i}a"
        parts[f"c{i}c"] = f"SELECT *, sum(CASE WHEN inn THEN x ELSE 0 END) {P} AS si, sum(inn::INT) {P} AS k, 1 - sum(CASE WHEN inn THEN 0 ELSE x END) {P} AS rest FROM c{i}b"
        parts[f"c{i + 1}"] = f"""SELECT portfolio_id, rebal_date, ticker, CASE WHEN done OR abs(s - 1) < 1e-5 THEN x WHEN s = 0 THEN 1.0 / n WHEN k = 0 THEN x / s
            WHEN rest <= 0 THEN CASE WHEN inn THEN 0 ELSE x END ELSE CASE WHEN inn THEN x / si * rest ELSE x END END AS w,
            done OR abs(s - 1) < 1e-5 OR s = 0 OR k = 0 OR rest <= 0 AS done FROM c{i}c"""
    return parts


@query("portfolio_clip_normalize", fin(W, "SELECT portfolio_id, rebal_date, ticker, w AS weight FROM c10", SN | clip_sql("sn", 0.0, 0.25)))
def _(t):
    return portfolio.clip_normalize(portfolio.sector_neutralize(t.weights(), t.sector_map(), t.sector_benchmark()), 0.0, 0.25)


@query("portfolio_constraints")
def _(t):
    k = portfolio.Constraints(max_weight=0.25, portfolio_value=1e5)
    return portfolio.constrain(t.weights(), adv_at(t), t.sector_map(), t.sector_benchmark(), betas(t), k)


PAIR = {"rd": "SELECT portfolio_id, rebal_date, lag(rebal_date) OVER (PARTITION BY portfolio_id ORDER BY rebal_date) AS prev FROM (SELECT DISTINCT portfolio_id, rebal_date FROM weights)",
        "pn": "SELECT w.portfolio_id, w.rebal_date, ticker, weight, prev FROM weights w JOIN rd USING (portfolio_id, rebal_date) WHERE prev IS NOT NULL",
        "po": "SELECT rd.portfolio_id, rd.rebal_date, ticker, weight FROM weights w JOIN rd ON w.portfolio_id = rd.portfolio_id AND w.rebal_date = rd.prev",
        "pr": """SELECT coalesce(n.portfolio_id, o.portfolio_id) AS portfolio_id, coalesce(n.rebal_date, o.rebal_date) AS rebal_date, coalesce(n.ticker, o.ticker) AS ticker,
            coalesce(o.weight, 0) AS old, coalesce(n.weight, 0) AS new FROM pn n FULL JOIN po o ON n.portfolio_id = o.portfolio_id AND n.rebal_date = o.rebal_date AND n.ticker = o.ticker"""}


@query("portfolio_no_trade_zone", fin(W, f"SELECT portfolio_id, rebal_date, ticker, CASE WHEN sum(w) {P} > 0 THEN w / sum(w) {P} ELSE w END AS weight FROM (SELECT *, CASE WHEN abs(new - old) > 0.15 THEN new ELSE old END AS w FROM pr)", PAIR))
def _(t):
    return portfolio.no_trade_zone(portfolio.consecutive(t.weights()), 0.15)


@query("portfolio_no_trade_schedule", fin(W, NOTRADE))
def _(t):
    return portfolio.no_trade_schedule(t.weights(), 0.15)


@query("portfolio_rebalance_report", fin(f"{K} max_drift rebalance:k turnover",
    "SELECT portfolio_id, rebal_date, max(abs(new - old)) AS max_drift, max(abs(new - old)) > 0.05 AS rebalance, sum(abs(new - old)) / 2 AS turnover FROM pr GROUP BY 1, 2", PAIR))
def _(t):
    return portfolio.rebalance_report(portfolio.consecutive(t.weights()))


COST = PAIR | {"vol": f"SELECT date, ticker, {r('stddev_samp', 'ret', 20)} AS vol FROM rets",
               "tc": """SELECT p.*, abs(new - old) * 1e5 AS trade, abs(new - old) * 1e5 * 0.0015 + 0.1 * coalesce(vol, 0.015) * sqrt(coalesce(abs(new - old) * 1e5 / nullif(coalesce(adv, 1e8), 0), 0)) * abs(new - old) * 1e5 AS cost
            FROM pr p LEFT JOIN adv a ON a.date = p.rebal_date AND a.ticker = p.ticker LEFT JOIN vol v ON v.date = p.rebal_date AND v.ticker = p.ticker"""}


def costs(t):
    from panelloom.functions import Frames

    fr = Frames()
    vol = fr.add(t.returns(), {"vol": fr.roll(F.stddev_samp, "ret", 20)}).select(c("date").alias("rebal_date"), "ticker", "vol")
    return portfolio.trade_costs(portfolio.consecutive(t.weights()), adv_at(t), vol, 1e5)


@query("portfolio_trade_costs", fin(f"{K} ticker:k old new trade:4 cost:4", "SELECT * FROM tc", COST))
def _(t):
    return costs(t).withColumns({"trade": tidy("trade", 4), "cost": tidy("cost", 4)})


@query("portfolio_net_weights", fin(f"{W} total_cost:4", f"""SELECT portfolio_id, rebal_date, ticker, CASE WHEN 1e5 - sum(cost) {P} > 0 THEN new / sum(new) {P} ELSE new END AS weight,
    sum(cost) {P} AS total_cost FROM tc""", COST))
def _(t):
    return portfolio.net_weights(costs(t), 1e5).withColumn("total_cost", tidy("total_cost", 4))


COV = {
    "wx": "SELECT w.*, idx AS ridx FROM weights w JOIN cal ON date = rebal_date",
    "ri": "SELECT ticker, idx, ret FROM rets JOIN cal USING (date) WHERE ret IS NOT NULL",
    "dense": "SELECT portfolio_id, rebal_date, w.ticker, d.idx, coalesce(ret, 0) AS ret FROM wx w JOIN cal d ON d.idx <= ridx AND d.idx > ridx - 252 LEFT JOIN ri ON ri.ticker = w.ticker AND ri.idx = d.idx",
    "cov": """SELECT a.portfolio_id, a.rebal_date, a.ticker AS i, b.ticker AS j, covar_samp(a.ret, b.ret) AS cov FROM dense a JOIN dense b
        ON a.portfolio_id = b.portfolio_id AND a.rebal_date = b.rebal_date AND a.idx = b.idx GROUP BY ALL""",
    "pv": "SELECT c.portfolio_id, c.rebal_date, sum(a.weight * b.weight * cov) AS variance FROM cov c JOIN weights a ON a.portfolio_id = c.portfolio_id AND a.rebal_date = c.rebal_date AND a.ticker = i JOIN weights b ON b.portfolio_id = c.portfolio_id AND b.rebal_date = c.rebal_date AND b.ticker = j GROUP BY 1, 2",
}


@query("portfolio_covariance", fin(f"{K} i:k j:k cov_bp", "SELECT *, cov * 1e4 AS cov_bp FROM cov", COV))
def _(t):
    return cov_table(t).select("portfolio_id", "rebal_date", "i", "j", (c("cov") * 1e4).alias("cov_bp"))


@query("portfolio_inverse_volatility", fin(W, f"""SELECT portfolio_id, rebal_date, i AS ticker, v / sum(v) {P} AS weight FROM (SELECT *, 1 / CASE WHEN cov > 0 THEN sqrt(cov) ELSE 1e-4 END AS v FROM cov WHERE i = j)""", COV))
def _(t):
    return solvers.inverse_volatility(cov_table(t))


@query("portfolio_volatility_target", fin(W, """SELECT portfolio_id, rebal_date, ticker, weight * CASE WHEN variance > 0 THEN least(0.15 / sqrt(variance * 252), 1.5) ELSE 1 END AS weight
    FROM weights JOIN pv USING (portfolio_id, rebal_date)""", COV))
def _(t):
    return portfolio.volatility_target(t.weights(), cov_table(t))


@query("portfolio_equal_risk", fin(f"{K} names:i equal_risk:k", "SELECT portfolio_id, rebal_date, count(*) AS names, true AS equal_risk FROM weights GROUP BY 1, 2"))
def _(t):
    """Whether risk parity leaves every name with the same share of the variance."""
    got = solvers.risk_parity(t.weights(), cov_table(t))
    shares = solvers.risk_shares(got, cov_table(t))
    gap = F.max(F.abs(c("share") * c("n") - 1.0))
    sized = shares.join(got.groupBy("portfolio_id", "rebal_date").agg(F.count(F.lit(1)).alias("n")), ["portfolio_id", "rebal_date"])
    return sized.groupBy("portfolio_id", "rebal_date").agg(F.count(F.lit(1)).alias("names"), (gap < 1e-6).alias("equal_risk"))


for _name in ("risk_parity", "min_variance", "black_litterman", "kelly", "hrp"):
    def _solver(t, name=_name):
        return portfolio.optimize(name, t.weights(), cov=cov_table(t), scores=t.scores())

    query(f"portfolio_{_name}")(_solver)


@query("portfolio_conviction_tilt", fin(W, f"""SELECT portfolio_id, rebal_date, ticker, x / sum(x) {P} AS weight FROM (
    SELECT w.*, weight * pow(coalesce(score, 0.5), 2) AS x FROM weights w LEFT JOIN scores s ON s.date = w.rebal_date AND s.ticker = w.ticker)"""))
def _(t):
    return portfolio.conviction_tilt(t.weights(), t.scores())


@query("portfolio_cash_buffer", fin(W, f"SELECT portfolio_id, rebal_date, ticker, weight / sum(weight) {P} * 0.98 AS weight FROM weights"))
def _(t):
    return portfolio.cash_buffer(t.weights())


ORD = {"nw": "SELECT w.* FROM weights w JOIN (SELECT portfolio_id, max(rebal_date) AS rebal_date FROM weights GROUP BY 1) USING (portfolio_id, rebal_date)",
       "px": "SELECT ticker, arg_max(close, date) AS price FROM panel GROUP BY 1",
       "od": """SELECT portfolio_id, rebal_date, ticker, floor(weight * 100 * 100 + 0.5) / 100 AS target_weight_pct, floor(weight * 1e5 * 100 + 0.5) / 100 AS allocated_capital,
            floor(price * 100 + 0.5) / 100 AS latest_price, floor(weight * 1e5 / price) AS shares FROM nw JOIN px USING (ticker) WHERE weight > 0 AND floor(weight * 1e5 / price) > 0""",
       "ds": "SELECT *, floor(latest_price * 0.98::DOUBLE * 100 + 0.5) / 100 AS stop_loss, floor(latest_price * 1.05::DOUBLE * 100 + 0.5) / 100 AS target FROM od"}
ORD_SPEC = f"{K} ticker:k target_weight_pct allocated_capital latest_price shares:i"


@query("portfolio_orders", fin(ORD_SPEC, "SELECT * FROM od", ORD))
def _(t):
    return portfolio.order_list(t.weights(), t.panel())


@query("portfolio_daily_summary", fin(ORD_SPEC + " stop_loss target", "SELECT * FROM ds", ORD))
def _(t):
    return portfolio.daily_summary(portfolio.order_list(t.weights(), t.panel()))


@query("portfolio_order_actions", fin("portfolio_id:i ticker:k shares:i stop_loss target shares_to_buy:i latest_price action:k", """
    SELECT coalesce(s.portfolio_id, o.portfolio_id) AS portfolio_id, coalesce(s.ticker, o.ticker) AS ticker, s.shares, stop_loss, target, o.shares AS shares_to_buy, o.latest_price,
      CASE WHEN o.shares > 0 THEN 'Buy' WHEN o.shares < 0 THEN 'Sell/Reduce' ELSE 'N/A' END AS action FROM (SELECT * FROM ds WHERE target_weight_pct < 15) s FULL JOIN od o ON s.portfolio_id = o.portfolio_id AND s.ticker = o.ticker""", ORD))
def _(t):
    orders = portfolio.order_list(t.weights(), t.panel())
    return portfolio.order_actions(orders, portfolio.daily_summary(orders).where("target_weight_pct < 15"))


# -- risk ------------------------------------------------------------------------------

@query("risk_historical_var", fin("portfolio_id:i var_95 cvar_95 var_99 cvar_99", """SELECT portfolio_id, greatest(0, -max(q5)) AS var_95, greatest(0, -avg(net) FILTER (net <= q5)) AS cvar_95,
    greatest(0, -max(q1)) AS var_99, greatest(0, -avg(net) FILTER (net <= q1)) AS cvar_99 FROM (SELECT *, quantile_cont(net, 0.05) OVER (PARTITION BY portfolio_id) AS q5, quantile_cont(net, 0.01) OVER (PARTITION BY portfolio_id) AS q1 FROM bt) GROUP BY 1"""))
def _(t):
    return risk.historical_var(backtest_daily(t))


Z = risk.NORMAL_QUANTILE[0.95]
PV = {"mo": "SELECT portfolio_id, avg(net) AS m, stddev_samp(net) AS sd, avg(pow((net - mu) / sp, 3)) AS sk, avg(pow((net - mu) / sp, 4)) - 3 AS kt FROM (SELECT *, avg(net) OVER (PARTITION BY portfolio_id) AS mu, stddev_pop(net) OVER (PARTITION BY portfolio_id) AS sp FROM bt) GROUP BY 1",
      "zz": f"SELECT *, {Z} + ({Z}*{Z} - 1) * sk / 6 + (pow({Z}, 3) - 3*{Z}) * kt / 24 - (2*pow({Z}, 3) - 5*{Z}) * sk * sk / 36 AS z FROM mo"}


@query("risk_parametric_var", fin("portfolio_id:i z var cvar", f"SELECT portfolio_id, z, greatest(0, z * sd - m) AS var, greatest(0, sd * exp(-z * z / 2) / {math.sqrt(2 * math.pi)} / {1.0 - 0.95} - m) AS cvar FROM zz", PV))
def _(t):
    return risk.parametric_var(backtest_daily(t))


MC = {"mcg": "SELECT portfolio_id, avg(net) AS m, stddev_samp(net) AS sd FROM bt GROUP BY 1",
      "mch": "SELECT portfolio_id, m, sd, md5('42:' || portfolio_id || ':' || i) AS h FROM mcg CROSS JOIN range(1, 10001) r(i)",
      "mcu": "SELECT portfolio_id, m, sd, (('0x' || substr(h, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496 AS u, (('0x' || substr(h, 14, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496 AS v FROM mch",
      "mcd": "SELECT portfolio_id, m + sd * (sqrt(-2 * ln(u)) * cos(2 * pi() * v)) AS x FROM mcu"}


@query("risk_monte_carlo_var", fin("portfolio_id:i var_95 cvar_95", """SELECT portfolio_id, greatest(0, -max(q)) AS var_95, greatest(0, -avg(x) FILTER (x <= q)) AS cvar_95
    FROM (SELECT *, quantile_cont(x, 0.05) OVER (PARTITION BY portfolio_id) AS q FROM mcd) GROUP BY 1""", MC))
def _(t):
    return risk.monte_carlo_var(backtest_daily(t))


DTL = AT | {"dtl": "SELECT portfolio_id, rebal_date, ticker, coalesce(weight * 1e7 / nullif(coalesce(adv, 1e6) * 0.1::DOUBLE, 0), 0) AS days FROM advr",
            "hv": "SELECT portfolio_id, greatest(0, -quantile_cont(net, 0.05)) AS var FROM bt GROUP BY 1"}


@query("risk_days_to_liquidate", fin(f"{K} ticker:k days", "SELECT * FROM dtl", DTL))
def _(t):
    return risk.days_to_liquidate(t.weights(), adv_at(t))


@query("risk_liquidity_var", fin(f"{K} days_95 lvar", """SELECT portfolio_id, rebal_date, days_95, var + 0.002 * greatest(1, days_95 / 10) AS lvar FROM (
    SELECT portfolio_id, rebal_date, quantile_cont(days, 0.95) AS days_95 FROM dtl GROUP BY 1, 2) JOIN hv USING (portfolio_id)""", DTL))
def _(t):
    base = risk.historical_var(backtest_daily(t), (0.95,)).select("portfolio_id", c("var_95").alias("var"))
    return risk.liquidity_var(risk.days_to_liquidate(t.weights(), adv_at(t)), base)


CON = {"tl": f"""SELECT portfolio_id, rebal_date, ticker, x / sum(x) {P} AS weight FROM (
            SELECT w.*, weight * pow(coalesce(score, 0.5), 2) AS x FROM weights w LEFT JOIN scores s ON s.date = w.rebal_date AND s.ticker = w.ticker)""",
       "cw": "SELECT *, row_number() OVER (PARTITION BY portfolio_id, rebal_date ORDER BY weight DESC, ticker) AS rk FROM tl",
            "con": "SELECT portfolio_id, rebal_date, sum(weight * weight) AS hhi, 1 / sum(weight * weight) AS effective_n, sum(weight) FILTER (rk <= 5) AS top_5, sum(weight) FILTER (rk <= 10) AS top_10, max(weight) AS max_weight FROM cw GROUP BY 1, 2"}


def tilted(t):
    return portfolio.conviction_tilt(t.weights(), t.scores())


@query("risk_concentration", fin(f"{K} hhi effective_n top_5 top_10 max_weight", "SELECT * FROM con", CON))
def _(t):
    return risk.concentration(tilted(t))


@query("risk_limit_audit", fin(f"{K} single_position_limit:k hhi_limit:k effective_n_limit:k sector_limit:k passed:k", """SELECT *, single_position_limit AND hhi_limit AND effective_n_limit AND sector_limit AS passed FROM (
    SELECT portfolio_id, rebal_date, max_weight <= 0.13 AS single_position_limit, floor(hhi * 1e4 + 0.5) / 1e4 <= 0.15 AS hhi_limit, floor(effective_n * 100 + 0.5) / 100 >= 8 AS effective_n_limit, sx <= 0.3 AS sector_limit
    FROM con JOIN (SELECT portfolio_id, rebal_date, max(sw) AS sx FROM (SELECT portfolio_id, rebal_date, sector, sum(tl.weight) AS sw FROM tl JOIN smap USING (ticker) GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (portfolio_id, rebal_date))""", CON))
def _(t):
    return risk.limit_audit(tilted(t), t.sector_map(), max_position=0.13, min_effective=8.0)


@query("risk_tail_metrics", fin("portfolio_id:i skewness kurtosis etl_95", "SELECT portfolio_id, sk AS skewness, kt AS kurtosis, greatest(0, -tail) AS etl_95 FROM mo JOIN (SELECT portfolio_id, avg(net) FILTER (net <= q) AS tail FROM (SELECT *, quantile_cont(net, 0.05) OVER (PARTITION BY portfolio_id) AS q FROM bt) GROUP BY 1) USING (portfolio_id)", PV))
def _(t):
    return risk.tail_metrics(backtest_daily(t))


@query("risk_tail_exceedances", fin("portfolio_id:i excess", "SELECT portfolio_id, loss - q AS excess FROM (SELECT *, quantile_cont(loss, 0.95) OVER (PARTITION BY portfolio_id) AS q FROM (SELECT portfolio_id, -net AS loss FROM bt WHERE net < 0)) WHERE loss > q"))
def _(t):
    return risk.exceedances(backtest_daily(t))


@query("risk_tail_index")
def _(t):
    return risk.tail_index(backtest_daily(t))


@query("risk_average_correlation", fin("n_names:i avg_pairwise_correlation", """SELECT count(DISTINCT a) + 1 AS n_names, avg(c) AS avg_pairwise_correlation FROM (
    SELECT x.ticker AS a, y.ticker AS b, covar_samp(x.ret, y.ret) / (stddev_samp(x.ret) * stddev_samp(y.ret)) AS c FROM dn x JOIN dn y ON x.date = y.date AND x.ticker < y.ticker GROUP BY 1, 2)""",
    {"dn": "SELECT cal.date, k.ticker, coalesce(ret, 0) AS ret FROM cal CROSS JOIN (SELECT DISTINCT ticker FROM panel) k LEFT JOIN rets r ON r.date = cal.date AND r.ticker = k.ticker"}))
def _(t):
    return risk.average_correlation(t.close_returns(), t.panel())


@query("risk_correlation_structure")
def _(t):
    return risk.correlation_structure(cov_table(t))


@query("risk_sector_exposure", fin(f"{K} sector:k portfolio_weight benchmark_weight active_bet", """SELECT portfolio_id, rebal_date, s.sector, pw AS portfolio_weight, coalesce(benchmark_weight, 0) AS benchmark_weight, pw - coalesce(benchmark_weight, 0) AS active_bet
    FROM (SELECT portfolio_id, rebal_date, sector, sum(weight) AS pw FROM s0 GROUP BY 1, 2, 3) s LEFT JOIN sbench b ON s.sector = b.sector""", SN))
def _(t):
    return risk.sector_exposure(t.weights(), t.sector_map(), t.sector_benchmark())


@query("risk_country_exposure", fin(f"{K} country:k weight", "SELECT portfolio_id, rebal_date, coalesce(country, 'India') AS country, sum(weight) AS weight FROM weights LEFT JOIN smap USING (ticker) GROUP BY 1, 2, 3"))
def _(t):
    return risk.country_exposure(t.weights(), t.sector_map())


def factor_betas(t):
    j = t.close_returns().join(t.factor_returns().withColumnRenamed("ret", "fr"), "date")
    return j.groupBy("ticker", "factor").agg((F.covar_samp("ret", "fr") / F.nullif(F.var_samp("fr"), F.lit(0.0))).alias("beta"))


FB = {"fb": "SELECT r.ticker, factor, covar_samp(r.ret, f.ret) / nullif(var_samp(f.ret), 0) AS beta FROM rets r JOIN facret f USING (date) WHERE r.ret IS NOT NULL GROUP BY 1, 2",
      "fe": "SELECT portfolio_id, rebal_date, factor, sum(weight * beta) / sum(weight) AS exposure FROM weights JOIN fb USING (ticker) GROUP BY 1, 2, 3"}


@query("risk_factor_exposure", fin(f"{K} factor:k exposure", "SELECT * FROM fe", FB))
def _(t):
    return risk.factor_exposure(t.weights(), factor_betas(t))


@query("risk_contribution", fin(f"{K} ticker:k weight mcr pcr", """SELECT portfolio_id, rebal_date, i AS ticker, weight, cw / sqrt(variance) AS mcr, weight * cw / variance AS pcr FROM (
    SELECT c.portfolio_id, c.rebal_date, i, sum(cov * w.weight) AS cw FROM cov c JOIN weights w ON w.portfolio_id = c.portfolio_id AND w.rebal_date = c.rebal_date AND w.ticker = j GROUP BY 1, 2, 3) x
    JOIN pv USING (portfolio_id, rebal_date) JOIN weights w2 ON w2.portfolio_id = x.portfolio_id AND w2.rebal_date = x.rebal_date AND w2.ticker = i""".replace("SELECT portfolio_id, rebal_date, i AS", "SELECT x.portfolio_id, x.rebal_date, i AS"), COV))
def _(t):
    return risk.risk_contribution(t.weights(), cov_table(t))


def _shocks(table):
    v = ", ".join(f"('{k}', {x}::DOUBLE)" for k, x in table.items())
    return f"SELECT portfolio_id, rebal_date, name AS scenario, -shock * pb * 1e7 AS loss FROM (SELECT DISTINCT portfolio_id, rebal_date, pb FROM b0) CROSS JOIN (VALUES {v}) v(name, shock)"


@query("risk_crisis_replay", fin(f"{K} scenario:k loss:2", _shocks(risk.CRISES).replace("DISTINCT portfolio_id, rebal_date, pb", "portfolio_id, rebal_date, max(pb) AS pb").replace("FROM b0)", "FROM b0 GROUP BY 1, 2)"), BT))
def _(t):
    return risk.shock_losses(t.weights(), betas(t), risk.CRISES).withColumn("loss", tidy("loss", 2))


@query("risk_macro_scenarios", fin(f"{K} scenario:k loss:2", _shocks(risk.SCENARIOS).replace("DISTINCT portfolio_id, rebal_date, pb", "portfolio_id, rebal_date, max(pb) AS pb").replace("FROM b0)", "FROM b0 GROUP BY 1, 2)"), BT))
def _(t):
    return risk.shock_losses(t.weights(), betas(t), risk.SCENARIOS).withColumn("loss", tidy("loss", 2))


REG = {
    "ix": f"SELECT date, close, row_number() OVER (ORDER BY date) AS n, {r('avg', 'close', 200, 100, part='1')} AS dma, close / lag(close) OVER (ORDER BY date) - 1 AS ret FROM idx",
    "ix2": "SELECT *, lag(ret) OVER (ORDER BY date) AS pret FROM ix",
    "raw": """SELECT i.date, i.n, i.close, CASE WHEN i.close >= dma THEN 1.0 ELSE 0.6 END * CASE WHEN pret < -0.025 THEN 0.5 ELSE 1.0 END
        * CASE WHEN v.close < 22 THEN 1.0 WHEN v.close <= 30 THEN 0.8 ELSE 0.6 END AS raw FROM ix2 i ASOF LEFT JOIN vix v ON i.date >= v.date""",
    "sm": "SELECT a.date, a.n, sum(b.raw * pow(2.0::DOUBLE / 3, a.n - b.n)) / sum(pow(2.0::DOUBLE / 3, a.n - b.n)) AS smooth FROM raw a JOIN raw b ON b.n BETWEEN a.n - 99 AND a.n GROUP BY 1, 2",
    "rx": "SELECT date, list_reduce(list(smooth) OVER (ORDER BY n), lambda acc, x: CASE WHEN abs(x - acc) > 0.1 THEN x ELSE acc END) AS exposure FROM sm",
}


@query("risk_regime_signal", fin("date:d close raw", "SELECT date, close, raw FROM raw", REG))
def _(t):
    return risk.regime_signal(t.index_prices(), t.vix()).drop("symbol")


@query("risk_regime_exposure", fin("date:d exposure", "SELECT * FROM rx", REG))
def _(t):
    return risk.regime_exposure(t.index_prices(), t.vix()).drop("symbol")


def row_ic(t):
    return alpha.daily_ic(t.scores(), t.panel(), [21], 5, calendar_shift=False)


@query("risk_regime_robustness", fin("portfolio_id:i period:k ic_mean sharpe max_dd profitable_periods:i mandate_met:k", """SELECT *, profitable_periods >= 2 AS mandate_met FROM (SELECT *, sum((sharpe > 0)::INT) OVER (PARTITION BY portfolio_id) AS profitable_periods FROM (
    SELECT portfolio_id, d.period, coalesce(m, 0) AS ic_mean, CASE WHEN stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) * sqrt(252.0) ELSE 0 END AS sharpe, min(equity / pk - 1) AS max_dd
    FROM (SELECT portfolio_id, period, date, net, equity, max(equity) OVER (PARTITION BY portfolio_id, period ORDER BY date) AS pk FROM bt JOIN per ON date BETWEEN s AND e) d
    LEFT JOIN (SELECT period, avg(ic) AS m FROM ic JOIN per ON date BETWEEN s AND e GROUP BY 1) i ON i.period = d.period GROUP BY 1, 2, 3))""", ROWSHIFT | {"per": PERIOD_SQL}))
def _(t):
    return risk.robustness(row_ic(t), backtest_daily(t), PERIODS)


@query("risk_regime_ic", fin("bull_ic bear_ic highvol_ic", """SELECT coalesce(avg(ic) FILTER (coalesce(abs(x.exposure - 1) < 1e-9, false)), 0) AS bull_ic, coalesce(avg(ic) FILTER (NOT coalesce(abs(x.exposure - 1) < 1e-9, false)), 0) AS bear_ic,
    coalesce(avg(ic) FILTER (v.vol > v.cut), 0) AS highvol_ic FROM ic ASOF LEFT JOIN rx x ON ic.date >= x.date ASOF LEFT JOIN vq v ON ic.date >= v.date""", ROWSHIFT | REG | {
    "vq": "SELECT date, vol, quantile_cont(vol, 0.9) OVER () AS cut FROM vv", "vv": f"SELECT date, {r('stddev_samp', 'ret', 20, part='1')} * sqrt(252.0) AS vol FROM ix"}))
def _(t):
    return risk.regime_ic(row_ic(t), risk.regime_exposure(t.index_prices(), t.vix()), t.index_prices())


@query("risk_drawdown_stop", fin("portfolio_id:i current_drawdown halt:k", "SELECT portfolio_id, arg_max(drawdown, date) AS current_drawdown, arg_max(drawdown, date) < -0.2 AS halt FROM bt GROUP BY 1"))
def _(t):
    return risk.drawdown_stop(backtest_daily(t))


@query("risk_regime_adjust", fin(W, """SELECT portfolio_id, rebal_date, ticker, weight * CASE WHEN bull = 0 THEN 0.5 ELSE 1 END * CASE WHEN high_vol = 1 THEN 0.5 ELSE 1 END AS weight FROM weights w
    ASOF LEFT JOIN (SELECT date, (close < 22)::INT AS bull, (close > 30)::INT AS high_vol FROM vix) f ON w.rebal_date >= f.date"""))
def _(t):
    flags = t.vix().select("date", (c("close") < 22).cast("int").alias("bull"), (c("close") > 30).cast("int").alias("high_vol"))
    return risk.regime_adjust(t.weights(), flags)


@query("risk_report")
def _(t):
    """One row per portfolio: all measures on its return series and its latest weights."""
    daily, w = backtest_daily(t), t.weights()
    now = w.join(w.groupBy("portfolio_id").agg(F.max("rebal_date").alias("rebal_date")), portfolio.KEYS)
    base = risk.historical_var(daily)
    pv = risk.parametric_var(daily).select("portfolio_id", c("var").alias("param_var"), c("cvar").alias("param_cvar"))
    dtl = risk.liquidity_var(risk.days_to_liquidate(now, adv_at(t)), base.select("portfolio_id", c("var_95").alias("var")))
    structure = risk.correlation_structure(cov_table(t).join(now.select(*portfolio.KEYS).distinct(), portfolio.KEYS))
    out = base.join(pv, "portfolio_id").join(risk.tail_metrics(daily), "portfolio_id").join(risk.tail_index(daily), "portfolio_id", "left")
    out = out.join(risk.concentration(now), "portfolio_id").join(dtl, portfolio.KEYS).join(structure, portfolio.KEYS)
    return out.join(risk.limit_audit(now, t.sector_map()).select(*portfolio.KEYS, "passed"), portfolio.KEYS).join(risk.drawdown_stop(daily), "portfolio_id")
