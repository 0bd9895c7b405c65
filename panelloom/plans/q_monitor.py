"""Queries: data quality, monitoring, insights, execution costs."""

from pyspark.sql import functions as F

from panelloom.functions import tidy
from panelloom.operators import alpha, backtest, features, insights, labels, monitoring, quality, risk, tca
from panelloom.plans.oracle import fin, pctrank, r
from panelloom.plans.q_alpha import IC, MIN
from panelloom.plans.q_backtest import ACT, SUM, backtest_daily, exposure
from panelloom.plans.q_risk import CON, FB, factor_betas, tilted
from panelloom.plans.registry import query

c = F.col

# -- cleaning ----------------------------------------------------------------------------

SEQ = "l_orderkey, l_linenumber, l_partkey, l_extendedprice"
CLEAN = {
    "d1": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, ticker ORDER BY {SEQ}) AS rn FROM panel_dirty) WHERE rn = 1",
    "d2": "SELECT *, CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL THEN 'missing' WHEN close <= 0 THEN 'price' END AS r1 FROM d1",
    "d3": "SELECT *, abs(close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1) > 0.3 AS jump FROM d2 WHERE r1 IS NULL",
    "d4": "SELECT *, coalesce(close = lag(close) OVER (PARTITION BY ticker ORDER BY date), false)::INT AS same FROM d3 WHERE NOT coalesce(jump, false)",
    "d5": "SELECT *, sum(same) OVER (PARTITION BY ticker ORDER BY date ROWS 3 PRECEDING) = 4 AS stale FROM d4",
}


@query("quality_flags", fin("date:d ticker:k close drop_reason:k", """
    SELECT date, ticker, close, r1 AS drop_reason FROM d2 WHERE r1 IS NOT NULL UNION ALL SELECT date, ticker, close, 'jump' FROM d3 WHERE jump
    UNION ALL SELECT date, ticker, close, CASE WHEN stale THEN 'stale' END FROM d5""", CLEAN))
def _(t):
    return quality.flag_steps(t.panel_dirty()).select("date", "ticker", "close", "drop_reason")


@query("quality_audit_report", fin("initial_rows:i final_rows:i dropped_duplicates:i dropped_missing:i dropped_price:i dropped_jump:i dropped_stale:i fail_share passed:k", """
    SELECT *, (initial_rows - final_rows)::DOUBLE / initial_rows AS fail_share, (initial_rows - final_rows)::DOUBLE / initial_rows <= 0.05 AS passed FROM (
    SELECT (SELECT count(*) FROM panel_dirty) AS initial_rows, (SELECT count(*) FROM d5 WHERE NOT stale) AS final_rows,
      (SELECT count(*) FROM panel_dirty) - (SELECT count(*) FROM d1) AS dropped_duplicates, (SELECT count(*) FROM d2 WHERE r1 = 'missing') AS dropped_missing,
      (SELECT count(*) FROM d2 WHERE r1 = 'price') AS dropped_price, (SELECT count(*) FROM d3 WHERE jump) AS dropped_jump, (SELECT count(*) FROM d5 WHERE stale) AS dropped_stale)""", CLEAN))
def _(t):
    return quality.audit(t.panel_dirty())


NUM = ["open", "high", "low", "close", "volume"]
FEED = {"fs": "SELECT *, " + ", ".join(f"avg({x}) OVER () AS m_{x}, stddev_samp({x}) OVER () AS s_{x}" for x in NUM) + " FROM panel_dirty",
        "st": "SELECT count(*) AS n, max(date) AS d, (" + " + ".join(f"avg(({x} IS NULL)::INT)" for x in NUM) + ") / 5 AS miss, "
              + "sum(" + " + ".join(f"coalesce(abs({x} - m_{x}) / (s_{x} + 1e-8) > 5, false)::INT" for x in NUM) + ") / (count(*) * 5.0::DOUBLE) AS outl, count(*) - count(DISTINCT (date, ticker)) AS dup, "
              + " + ".join(f"(stddev_samp({x}) < 1e-10)::INT" for x in NUM) + " AS con FROM fs",
        "ck": """SELECT 'row_count' AS "check", n::DOUBLE AS value, n >= 10 AS passed, CASE WHEN n = 0 THEN 'CRITICAL' WHEN n < 10 THEN 'WARNING' ELSE 'OK' END AS severity FROM st
            UNION ALL SELECT 'missing_values', miss, miss <= 0.05, CASE WHEN miss > 0.2 THEN 'CRITICAL' WHEN miss > 0.05 THEN 'WARNING' ELSE 'OK' END FROM st
            UNION ALL SELECT 'outliers', outl, outl < 0.01, CASE WHEN outl >= 0.01 THEN 'WARNING' ELSE 'OK' END FROM st
            UNION ALL SELECT 'staleness', DATE '2001-12-31' - d, DATE '2001-12-31' - d <= 3, CASE WHEN DATE '2001-12-31' - d > 7 THEN 'CRITICAL' WHEN DATE '2001-12-31' - d > 3 THEN 'WARNING' ELSE 'OK' END FROM st
            UNION ALL SELECT 'duplicates', dup, dup = 0, CASE WHEN dup > 0 THEN 'WARNING' ELSE 'OK' END FROM st
            UNION ALL SELECT 'constant_columns', con, con = 0, CASE WHEN con > 0 THEN 'INFO' ELSE 'OK' END FROM st"""}


def feed(t):
    return quality.feed_checks(t.panel_dirty(), NUM, ["date", "ticker"], "2001-12-31")


@query("quality_feed_checks", fin("check:k value passed:k severity:k", "SELECT * FROM ck", FEED).replace("check AS check", '"check"').replace("SELECT check,", 'SELECT "check",'))
def _(t):
    return feed(t)


@query("quality_feed_report", fin("passed:k failed_checks:k", """SELECT bool_and(passed) AS passed, coalesce(string_agg("check", ',' ORDER BY "check") FILTER (NOT passed), '') AS failed_checks FROM ck""", FEED))
def _(t):
    return quality.feed_report(feed(t))


@query("quality_worst_column", fin("column_name:k missing", "SELECT 'close' AS column_name, avg((close IS NULL)::INT) AS missing FROM panel_dirty"))
def _(t):
    return quality.worst_column(t.panel_dirty(), NUM).withColumnRenamed("column", "column_name")


@query("quality_common_dates", fin("n_common:i passed:k", "SELECT count(*) AS n_common, count(*) >= 100 AS passed FROM (SELECT date FROM panel INTERSECT SELECT date FROM vix)"))
def _(t):
    return quality.common_dates(t.panel(), t.vix())


@query("quality_feature_audit")
def _(t):
    cols = [x for f in features.FAMILIES.values() for x in f.columns]
    df = features.compute_families(t.panel(), t.market().withColumnRenamed("mkt_ret", "ctx_ret"))
    return quality.column_audit(df, quality.feature_rules(), cols)


_AUD = {"au": f"SELECT {r('avg', 'close', 5)} AS x, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS y FROM panel"}


@query("quality_column_audit", fin("column_name:k check_name:k value passed:k", """
    SELECT 'return_1m' AS column_name, 'infinite' AS check_name, 0.0 AS value, true AS passed UNION ALL SELECT 'return_1m', 'null_share', avg((return_1m IS NULL)::INT), avg((return_1m IS NULL)::INT) <= 0.5 FROM core
    UNION ALL SELECT 'roe', 'infinite', 0.0, true UNION ALL SELECT 'roe', 'filled_share', 1 - avg((roe IS NULL)::INT), 1 - avg((roe IS NULL)::INT) >= 0.1 FROM core
    UNION ALL SELECT 'volatility_regime', 'infinite', 0.0, true UNION ALL SELECT 'volatility_regime', 'minimum', min(volatility_regime), min(volatility_regime) >= 0 FROM core
    UNION ALL SELECT 'roe', 'exists', 1, true"""))
def _(t):
    rules = {"return_1m": {"max_null": 0.5}, "roe": {"min_filled": 0.1}, "volatility_regime": {"low": 0.0}}
    return quality.column_audit(t.core(), rules, ["roe"]).withColumnsRenamed({"column": "column_name", "check": "check_name"})


_HORIZONS = labels.LabelConfig().horizons
_LABELS = {"lf": "SELECT date, ticker, " + ", ".join(f"lead(close, {h}) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS f{h}" for h in _HORIZONS) + " FROM panel",
           "lr": "SELECT *, " + ", ".join(f"{pctrank(f'f{h}')} AS r{h}" for h in _HORIZONS) + " FROM lf"}


@query("quality_label_audit", fin("column_name:k check_name:k value passed:k", " UNION ALL ".join(f"""
    SELECT 'ret_fwd_{h}d' AS column_name, 'infinite' AS check_name, 0.0 AS value, true AS passed UNION ALL SELECT 'ret_fwd_{h}d', 'filled_share', avg((f{h} IS NOT NULL)::INT), avg((f{h} IS NOT NULL)::INT) >= 0.5 FROM lr
    UNION ALL SELECT 'binary_fwd_{h}d', 'infinite', 0, true UNION ALL SELECT 'binary_fwd_{h}d', 'not_binary', 0, true UNION ALL SELECT 'binary_fwd_{h}d', 'positive_share', avg((f{h} > 0)::INT), avg((f{h} > 0)::INT) BETWEEN 0.2 AND 0.8 FROM lr
    UNION ALL SELECT 'rank_pct_fwd_{h}d', 'infinite', 0, true UNION ALL SELECT 'rank_pct_fwd_{h}d', 'minimum', min(r{h}), min(r{h}) >= 0 FROM lr
    UNION ALL SELECT 'rank_pct_fwd_{h}d', 'maximum', max(r{h}), max(r{h}) <= 1 FROM lr""" for h in _HORIZONS), _LABELS))
def _(t):
    """Every label family at every horizon."""
    df = labels.label_panel(t.panel(), labels.LabelConfig())
    return quality.column_audit(df, quality.label_rules(_HORIZONS)).withColumnsRenamed({"column": "column_name", "check": "check_name"})



# -- drift -------------------------------------------------------------------------------

DF = features.CORE_COLUMNS[:11]
SPLIT = "DATE '1998-01-01'"
DRIFT = {
    "smp": " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS v, date < {SPLIT} AS is_ref FROM core WHERE {f} IS NOT NULL" for f in DF),
    "eg": "SELECT feature, list_sort(list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM smp WHERE is_ref GROUP BY 1",
    "bn": "SELECT feature, is_ref, CASE WHEN v = e[len(e)] THEN len(e) - 1 ELSE len(list_filter(e, lambda x: x <= v)) END AS bin FROM smp JOIN eg USING (feature) WHERE v BETWEEN e[1] AND e[len(e)]",
    "bc": "SELECT feature, bin, count(*) FILTER (is_ref) AS r, count(*) FILTER (NOT is_ref) AS k FROM bn GROUP BY 1, 2",
    "bp": "SELECT feature, greatest(r::DOUBLE / sum(r) OVER (PARTITION BY feature), 1e-6) AS pr, greatest(k::DOUBLE / sum(k) OVER (PARTITION BY feature), 1e-6) AS pk FROM bc",
    "psi": "SELECT feature, sum((pk - pr) * ln(pk / pr)) AS psi FROM bp GROUP BY 1",
    "ks0": "SELECT feature, v, sum(is_ref::INT) OVER w AS cr, sum((NOT is_ref)::INT) OVER w AS ck, sum(is_ref::INT) OVER (PARTITION BY feature) AS n, sum((NOT is_ref)::INT) OVER (PARTITION BY feature) AS m FROM smp WINDOW w AS (PARTITION BY feature ORDER BY v RANGE UNBOUNDED PRECEDING)",
    "ks": "SELECT feature, max(abs(cr::DOUBLE / n - ck::DOUBLE / m)) AS ks_statistic, max(n)::DOUBLE AS n, max(m)::DOUBLE AS m FROM ks0 GROUP BY 1",
    "kp": "SELECT feature, ks_statistic, CASE WHEN t < 0.2 THEN 1 ELSE greatest(0, least(1, list_sum(list_transform(range(1, 51), lambda k: 2 * pow(-1, k - 1) * exp(-2 * k * k * t * t))))) END AS ks_pvalue FROM (SELECT *, ks_statistic * sqrt(n * m / (n + m)) AS t FROM ks)",
    "dr": "SELECT feature, psi, ks_statistic, ks_pvalue, psi > 0.2 OR ks_pvalue < 0.05 AS drifted, CASE WHEN psi > 0.2 THEN 'CRITICAL' WHEN ks_pvalue < 0.05 THEN 'WARNING' ELSE 'OK' END AS severity FROM psi JOIN kp USING (feature)",
}


def halves(t, df=None):
    df = t.core() if df is None else df
    cut = F.lit("1998-01-01").cast("date")
    return df.where(c("date") < cut), df.where(c("date") >= cut)


@query("drift_psi", fin("feature:k psi", "SELECT * FROM psi", DRIFT))
def _(t):
    return monitoring.psi(monitoring.two_samples(*halves(t), DF)).select("feature", "psi")


@query("drift_ks_test", fin("feature:k ks_statistic ks_pvalue", "SELECT * FROM kp", DRIFT))
def _(t):
    return monitoring.ks_test(monitoring.two_samples(*halves(t), DF))


@query("drift_features", fin("feature:k psi ks_statistic ks_pvalue drifted:k severity:k", "SELECT * FROM dr", DRIFT))
def _(t):
    return monitoring.feature_drift(*halves(t), DF)


@query("drift_rate", fin("drift_rate", f"SELECT sum(drifted::INT) / {len(DF)}::DOUBLE AS drift_rate FROM dr", DRIFT))
def _(t):
    return monitoring.drift_rate(monitoring.feature_drift(*halves(t), DF), len(DF))


@query("drift_predictions", fin("feature:k psi ks_statistic ks_pvalue mean_shift std_shift drifted:k", """SELECT feature, psi, ks_statistic, ks_pvalue, mean_shift, std_shift, psi > 0.1 OR ks_pvalue < 0.05 AS drifted FROM dr JOIN (
    SELECT feature, avg(v) FILTER (NOT is_ref) - avg(v) FILTER (is_ref) AS mean_shift, stddev_pop(v) FILTER (NOT is_ref) - stddev_pop(v) FILTER (is_ref) AS std_shift FROM smp GROUP BY 1) USING (feature)""",
    DRIFT | {"smp": f"SELECT 'bollinger_distance' AS feature, bollinger_distance AS v, date < {SPLIT} AS is_ref FROM core WHERE bollinger_distance IS NOT NULL"}))
def _(t):
    return monitoring.prediction_drift(*halves(t), "bollinger_distance")


# -- strategy health ---------------------------------------------------------------------

SH = {"sh": f"SELECT portfolio_id, date, ({r('avg', 'net', 63, part='portfolio_id')} - (pow(1.065::DOUBLE, 1 / 252.0) - 1)) / nullif({r('stddev_samp', 'net', 63, part='portfolio_id')}, 0) * sqrt(252.0) AS s FROM bt"}


@query("monitor_rolling_sharpe", fin("portfolio_id:i latest_sharpe mean_sharpe min_sharpe pct_positive breach:k", """SELECT *, latest_sharpe < 0.5 AS breach FROM (SELECT portfolio_id, coalesce(arg_max_null(s, date), 0) AS latest_sharpe,
    avg(s) AS mean_sharpe, min(s) AS min_sharpe, avg((s > 0)::INT) AS pct_positive FROM sh GROUP BY 1)""", SH))
def _(t):
    return monitoring.sharpe_check(backtest_daily(t))


@query("monitor_rolling_ic", fin("latest_ic mean_ic ic_ir pct_positive breach:k", f"""SELECT *, latest_ic < 0.02 AS breach FROM (SELECT coalesce(arg_max_null(m, date), 0) AS latest_ic, avg(m) AS mean_ic, avg(ic) / stddev_samp(ic) AS ic_ir, avg((ic > 0)::INT) AS pct_positive
    FROM (SELECT *, {r('avg', 'ic', 21, part='1')} AS m FROM (SELECT d.date, coalesce(ic.ic, 0) AS ic FROM (SELECT DISTINCT date FROM scores) d LEFT JOIN ic USING (date))))""", IC))
def _(t):
    return monitoring.ic_check(alpha.daily_ic(t.scores(), t.panel(), [21], MIN), t.scores())


@query("monitor_drawdown", fin("portfolio_id:i current_drawdown max_drawdown duration_days:i breach:k", """SELECT portfolio_id, arg_max(drawdown, date) AS current_drawdown, min(drawdown) AS max_drawdown,
    greatest(0, coalesce(max(date) FILTER (drawdown < -1e-4) - arg_min(date, (drawdown, date)), 0)) AS duration_days, arg_max(drawdown, date) < -0.2 AS breach FROM bt GROUP BY 1"""))
def _(t):
    return monitoring.drawdown_check(backtest_daily(t))


@query("monitor_latency", fin("operation:k count:i mean_ms p50_ms p95_ms p99_ms max_ms", """SELECT operation, count(*) AS count, avg(latency_ms) AS mean_ms, quantile_cont(latency_ms, 0.5) AS p50_ms, quantile_cont(latency_ms, 0.95) AS p95_ms,
    quantile_cont(latency_ms, 0.99) AS p99_ms, max(latency_ms) AS max_ms FROM ops GROUP BY 1"""))
def _(t):
    return monitoring.latency_summary(t.ops_log())


ERR = "SELECT operation, sum((NOT success)::INT) AS errors, count(*) AS calls, sum((NOT success)::INT)::DOUBLE / count(*) AS error_rate FROM ops GROUP BY 1 HAVING sum((NOT success)::INT) > 0"


@query("monitor_errors", fin("operation:k errors:i calls:i error_rate", ERR))
def _(t):
    return monitoring.error_summary(t.ops_log())


@query("monitor_threshold_alerts", fin("operation:k severity:k n:i value metric:k", f"""SELECT operation, CASE WHEN latency_ms >= 2000 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, count(*) AS n, max(latency_ms) AS value, 'latency' AS metric FROM ops WHERE latency_ms >= 500 GROUP BY 1, 2
    UNION ALL SELECT operation, CASE WHEN error_rate >= 0.05 THEN 'CRITICAL' ELSE 'WARNING' END, errors, error_rate, 'error_rate' FROM ({ERR}) WHERE error_rate >= 0.01"""))
def _(t):
    return monitoring.threshold_alerts(t.ops_log())


@query("monitor_alert_counts", fin("severity:k n:i", "SELECT severity, count(*) AS n FROM alerts GROUP BY 1"))
def _(t):
    return monitoring.alert_counts(t.alerts())


@query("monitor_recent_alerts", fin("event_id:i severity:k category:k metric:k value", "SELECT * FROM alerts ORDER BY ts DESC, event_id DESC LIMIT 20"))
def _(t):
    return monitoring.recent_alerts(t.alerts()).select("event_id", "severity", "category", "metric", "value")


@query("monitor_overall_health", fin("critical:i warning:i overall_health:k", """SELECT count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'WARNING') AS warning,
    CASE WHEN bool_or(severity = 'CRITICAL') THEN 'CRITICAL' WHEN bool_or(severity = 'WARNING') THEN 'WARNING' ELSE 'HEALTHY' END AS overall_health FROM alerts"""))
def _(t):
    return monitoring.health(t.alerts())


_T = "epoch_us(ts) / 1e6"


@query("monitor_alert_episodes", fin("event_id:i episode:i", f"""SELECT event_id, sum(f) OVER (PARTITION BY category, metric, severity ORDER BY t, event_id) AS episode FROM (
    SELECT *, (coalesce(t - lag(t) OVER (PARTITION BY category, metric, severity ORDER BY t, event_id) >= 300, true))::INT AS f FROM (SELECT *, {_T} AS t FROM alerts))"""))
def _(t):
    return monitoring.quiet_periods(t.alerts()).select("event_id", "episode")


@query("monitor_alert_cooldown", "WITH RECURSIVE " + fin("event_id:i", "SELECT event_id FROM fired", {
    "al": f"SELECT event_id, category, metric, severity, {_T} AS t, row_number() OVER (PARTITION BY category, metric, severity ORDER BY ts, event_id) AS n FROM alerts",
    "fired": """SELECT event_id, category, metric, severity, n, t AS last FROM al WHERE n = 1
        UNION ALL SELECT x.event_id, x.category, x.metric, x.severity, x.n, x.t FROM fired f JOIN LATERAL (SELECT * FROM al a WHERE a.category = f.category AND a.metric = f.metric AND a.severity = f.severity
          AND a.n > f.n AND a.t - f.last >= 300 ORDER BY a.n LIMIT 1) x ON true"""})[len("WITH "):])
def _(t):
    return monitoring.cooldown_filter(t.alerts()).select("event_id")


@query("monitor_alert_throttle")
def _(t):
    return monitoring.throttle(t.alerts().withColumn("service", F.lit("panel")), hourly_cap=12).select("event_id", "severity", "category", "metric")


# -- anomalies and text --------------------------------------------------------------------

SPK = {"rr": "SELECT date, ticker, ret FROM rets WHERE ret IS NOT NULL",
       "sp0": f"SELECT *, (ret - {r('avg', 'ret', 60)}) / nullif({r('stddev_samp', 'ret', 60)}, 0) AS z_score FROM rr",
       "spk": "SELECT *, CASE WHEN z_score > 0 THEN 'SPIKE UP' ELSE 'CRASH DOWN' END AS anomaly_type FROM sp0 WHERE abs(z_score) > 2"}


@query("insight_return_spikes", fin("ticker:k date:d ret z_score anomaly_type:k", "SELECT * FROM spk", SPK))
def _(t):
    return insights.return_spikes(t.close_returns(), limit=2.0)


@query("insight_spike_rate", fin("total_anomalies:i anomaly_rate", "SELECT (SELECT count(*) FROM spk) AS total_anomalies, (SELECT count(*) FROM spk)::DOUBLE / (SELECT count(DISTINCT date) * count(DISTINCT ticker) FROM rr) AS anomaly_rate", SPK))
def _(t):
    return insights.spike_rate(t.close_returns(), insights.return_spikes(t.close_returns(), limit=2.0))


@query("insight_prediction_outliers", fin("date:d ticker:k score z_score severity:k", f"""SELECT date, ticker, x AS score, z AS z_score, CASE WHEN abs(z) > 4 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM (
    SELECT date, ticker, volume_shock AS x, (volume_shock - (SELECT m FROM ps)) / (SELECT sd FROM ps) AS z FROM vs WHERE date >= {SPLIT}) WHERE abs(z) > 2""", {
    "vs": "SELECT date, ticker, volume_shock FROM core WHERE volume_shock IS NOT NULL",
    "ps": f"SELECT avg(volume_shock) AS m, stddev_samp(volume_shock) AS sd FROM vs WHERE date < {SPLIT}"}).replace("vs AS (", "vs AS MATERIALIZED (").replace("ps AS (", "ps AS MATERIALIZED ("))
def _(t):
    base, now = halves(t, t.core().select("date", "ticker", c("volume_shock").alias("score")))
    return insights.prediction_outliers(now, base, limit=2.0)


BETA2 = {f"fb{i}": f"SELECT r.ticker, factor, covar_samp(r.ret, f.ret) / nullif(var_samp(f.ret), 0) AS beta FROM rets r JOIN facret f USING (date) WHERE r.ret IS NOT NULL AND date {op} {SPLIT} GROUP BY 1, 2" for i, op in ((0, "<"), (1, ">="))}


@query("insight_factor_shift", fin("ticker:k factor:k current_beta baseline_beta shift direction:k", """SELECT *, CASE WHEN shift > 0 THEN 'ROTATION IN' ELSE 'ROTATION OUT' END AS direction FROM (
    SELECT a.ticker, a.factor, a.beta AS current_beta, coalesce(b.beta, 0) AS baseline_beta, a.beta - coalesce(b.beta, 0) AS shift FROM fb1 a LEFT JOIN fb0 b ON a.ticker = b.ticker AND a.factor = b.factor) WHERE abs(shift) > 0.2""", BETA2))
def _(t):
    old, new = halves(t, t.close_returns().join(t.factor_returns().withColumnRenamed("ret", "fr"), "date"))
    beta = lambda df: df.groupBy("ticker", "factor").agg((F.covar_samp("ret", "fr") / F.nullif(F.var_samp("fr"), F.lit(0.0))).alias("beta"))
    return insights.factor_shift(beta(new), beta(old), ["ticker", "factor"], 0.2)


# a lexicon that occurs in the given prose
POS, NEG = ["that", "with", "from"], ["worthless", "license", "this"]


def _words(ws):
    return " + ".join(f"len(regexp_extract_all(tx, '\\b{x}\\b'))" for x in ws)


TXT = {"n0": "SELECT *, lower(coalesce(headline, '') || ' ' || coalesce(content, '')) AS tx FROM news",
       "n1": f"SELECT *, {_words(POS)} AS n_positive, {_words(NEG)} AS n_negative FROM n0",
       "n2": "SELECT *, CASE WHEN n_positive + n_negative > 0 THEN (n_positive - n_negative)::DOUBLE / (n_positive + n_negative) ELSE 0 END AS sentiment_score FROM n1",
       "n3": """SELECT *, CASE WHEN sentiment_score > 0.25 THEN 'POSITIVE' WHEN sentiment_score < -0.25 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment_label,
        CASE WHEN sentiment_score > 0.6 THEN 'HIGH BULLISH' WHEN sentiment_score > 0.25 THEN 'MODERATE BULLISH' WHEN sentiment_score < -0.6 THEN 'HIGH BEARISH' WHEN sentiment_score < -0.25 THEN 'MODERATE BEARISH' ELSE 'LOW IMPACT' END AS market_impact FROM n2"""}
TXT_SPEC = "doc_id:i n_positive:i n_negative:i sentiment_score sentiment_label:k market_impact:k"


@query("insight_news_sentiment", fin(TXT_SPEC, "SELECT * FROM n3", TXT))
def _(t):
    return insights.news_sentiment(t.news(), POS, NEG).select("doc_id", "n_positive", "n_negative", "sentiment_score", "sentiment_label", "market_impact")


@query("insight_news_default_lexicon", fin("doc_id:i n_positive:i n_negative:i", "SELECT doc_id, "
    + " + ".join(f"len(regexp_extract_all(tx, '\\b{x}\\b'))" for x in insights.POSITIVE) + " AS n_positive, "
    + " + ".join(f"len(regexp_extract_all(tx, '\\b{x}\\b'))" for x in insights.NEGATIVE) + " AS n_negative FROM n0", TXT))
def _(t):
    return insights.news_sentiment(t.news()).select("doc_id", "n_positive", "n_negative")


@query("insight_takeaways", fin("doc_id:i takeaways:k", """SELECT doc_id, array_to_string(CASE WHEN len(k) > 0 THEN k[1:3] ELSE [headline] END, '|') AS takeaways FROM (
    SELECT doc_id, headline, list_filter(list_transform(regexp_split_to_array(content, '[.!?]'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 20) AS k FROM news)"""))
def _(t):
    return t.news().select("doc_id", F.array_join(insights.takeaways(c("content"), c("headline")), "|").alias("takeaways"))


@query("insight_earnings", fin(TXT_SPEC + " guidance_discussed:k margin_discussed:k executive_memo:k", """SELECT *, symbol || ' Q4 2025: tone ' || sentiment_label || ', impact ' || market_impact
    || CASE WHEN guidance_discussed THEN ', guidance discussed' ELSE '' END || CASE WHEN margin_discussed THEN ', margins discussed' ELSE '' END AS executive_memo
    FROM (SELECT *, contains(lower(content), 'guidance') AS guidance_discussed, contains(lower(content), 'margin') AS margin_discussed FROM n3)""",
    TXT | {"n0": "SELECT *, lower(symbol || ' Q4 2025 Earnings Call ' || coalesce(content, '')) AS tx FROM news"}))
def _(t):
    return insights.earnings_summary(t.news(), "Q4", 2025, POS, NEG).select(
        "doc_id", "n_positive", "n_negative", "sentiment_score", "sentiment_label", "market_impact", "guidance_discussed", "margin_discussed", "executive_memo")


# -- attributions: z-scored features of each row stand in for contributions -----------------

ATF = features.CORE_COLUMNS[:11]
AKEYS = ["date", "ticker"]
ATT = {"att": " UNION ALL ".join(
    f"SELECT date, ticker, '{f}' AS feature, ({f} - avg({f}) OVER (PARTITION BY date)) / CASE WHEN stddev_samp({f}) OVER (PARTITION BY date) = 0 THEN 1e-6 ELSE stddev_samp({f}) OVER (PARTITION BY date) END * 0.01 AS value FROM core" for f in ATF),
    "atk": "SELECT *, row_number() OVER (PARTITION BY date, ticker ORDER BY abs(value) DESC, feature) AS rank FROM att WHERE value IS NOT NULL"}


def contributions(t):
    """One row per key, the attribution to each feature in its column."""
    from panelloom.operators import xsection

    z = xsection.zscore(t.core().select("date", "ticker", *ATF), ATF)
    return z.select(*AKEYS, *[(c(f) * 0.01).alias(f) for f in ATF])


def attributions(t):
    return contributions(t).unpivot(AKEYS, ATF, "feature", "value")


@query("model_attribution_importance", fin("feature:k mean_abs rank:i", "SELECT *, row_number() OVER (ORDER BY mean_abs DESC, feature) AS rank FROM (SELECT feature, avg(abs(value)) AS mean_abs FROM att GROUP BY 1)", ATT))
def _(t):
    from panelloom.operators import models

    return models.attribution_importance(attributions(t))


@query("model_local_explanation", fin("date:d ticker:k feature:k value", "SELECT * FROM atk", ATT))
def _(t):
    from panelloom.operators import models

    return models.local_explanation(attributions(t), AKEYS).drop("rank")


@query("insight_explain_predictions", fin("date:d ticker:k direction:k stance:k n_drivers:i narrative:k", """SELECT s.date, s.ticker, direction, stance, coalesce(n, 0) AS n_drivers, 'The model maintains a ' || direction || ' stance (' || stance || ') on ' || s.ticker || ' with an expected return of ' || printf('%+.2f', 100.0 * x) || '%.' AS narrative FROM (
    SELECT date, ticker, x, CASE WHEN x > 0.02 THEN 'BULLISH' WHEN x < -0.02 THEN 'BEARISH' ELSE 'NEUTRAL' END AS direction, CASE WHEN x > 0.05 THEN 'Strong Outperform' WHEN x > 0.02 THEN 'Moderate Outperform' WHEN x < -0.05 THEN 'Strong Underperform' WHEN x < -0.02 THEN 'Moderate Underperform' ELSE 'Market Perform' END AS stance
    FROM (SELECT date, ticker, (score - 0.5) * 0.2 AS x FROM scores)) s LEFT JOIN (SELECT date, ticker, count(*) AS n FROM atk WHERE rank <= 5 GROUP BY 1, 2) a USING (date, ticker)""", ATT))
def _(t):
    parts = contributions(t)  # first, so that the scores read the core features made for it
    pred = t.scores().select("date", "ticker", ((c("score") - 0.5) * 0.2).alias("score"))
    df = insights.explain_predictions(pred, parts, AKEYS, features=ATF)
    return df.select("date", "ticker", "direction", "stance", F.coalesce(F.size(F.split("key_drivers", ",")), F.lit(0)).alias("n_drivers"), "narrative")


@query("insight_attribution_split", fin("date:d ticker:k total_attribution final_prediction n_positive:i n_negative:i", """SELECT t.date, t.ticker, total_attribution, total_attribution + 0.5 AS final_prediction, coalesce(p, 0) AS n_positive, coalesce(n, 0) AS n_negative
    FROM (SELECT date, ticker, sum(value) AS total_attribution FROM att GROUP BY 1, 2) t LEFT JOIN (SELECT date, ticker, count(*) FILTER (value > 0) AS p, count(*) FILTER (value < 0) AS n FROM atk WHERE rank <= 5 GROUP BY 1, 2) s USING (date, ticker)""", ATT))
def _(t):
    df = insights.attribution_split(contributions(t), AKEYS, base=0.5, features=ATF)
    n = lambda x: F.when(F.length(x) > 0, F.size(F.split(x, ","))).otherwise(0)
    return df.select("date", "ticker", "total_attribution", "final_prediction", n(c("positive_drivers")).alias("n_positive"), n(c("negative_drivers")).alias("n_negative"))


RG = CON | {"lc": "SELECT portfolio_id, top_5 FROM con JOIN (SELECT portfolio_id, max(rebal_date) AS rebal_date FROM con GROUP BY 1) USING (portfolio_id, rebal_date)",
            "hv": "SELECT portfolio_id, greatest(0, -max(q)) AS var, greatest(0, -avg(net) FILTER (net <= q)) AS cvar FROM (SELECT *, quantile_cont(net, 0.05) OVER (PARTITION BY portfolio_id) AS q FROM bt) GROUP BY 1",
            "rg": """SELECT *, CASE WHEN n_alerts = 0 THEN 'LOW' WHEN n_alerts = 1 THEN 'MODERATE' ELSE 'HIGH' END AS risk_grade FROM (SELECT portfolio_id, var, cvar, top_5,
                concat_ws(',', CASE WHEN var > 0.03 THEN 'HIGH TAIL RISK' END, CASE WHEN top_5 > 0.4 THEN 'HIGH CONCENTRATION' END, 'MANDATE BREACH') AS alerts, (var > 0.03)::INT + (top_5 > 0.4)::INT + 1 AS n_alerts,
                CASE WHEN CASE WHEN var > 0 THEN cvar / var ELSE 1 END > 1.4 THEN 'Fat-tailed' ELSE 'Normal' END AS tail FROM hv JOIN lc USING (portfolio_id))"""}


def grade(t):
    con = risk.concentration(tilted(t))
    latest = con.groupBy("portfolio_id").agg(F.max_by("top_5", "rebal_date").alias("top_5"))
    v = risk.historical_var(backtest_daily(t), (0.95,)).select("portfolio_id", c("var_95").alias("var"), c("cvar_95").alias("cvar"))
    return insights.risk_grade(v.join(latest, "portfolio_id").withColumn("mandate_met", F.lit(False)))


@query("insight_risk_grade", fin("portfolio_id:i var cvar top_5 alerts:k n_alerts:i risk_grade:k tail:k", "SELECT * FROM rg", RG))
def _(t):
    return grade(t).drop("mandate_met")


@query("insight_dominant_factor", fin("portfolio_id:i rebal_date:d factor:k exposure", "SELECT portfolio_id, rebal_date, arg_max(factor, (abs(exposure), factor)) AS factor, arg_max(exposure, (abs(exposure), factor)) AS exposure FROM fe GROUP BY 1, 2", FB))
def _(t):
    return insights.dominant_factor(risk.factor_exposure(t.weights(), factor_betas(t)), ["portfolio_id", "rebal_date"])


ADVICE_SQL = "CASE domain " + " ".join(f"WHEN '{d}' THEN '{text}'" for d, (_, text, _) in insights.ADVICE.items()) + " END"


@query("insight_recommendations", fin("portfolio_id:i priority:k domain:k recommendation:k", f"""
    SELECT portfolio_id, priority, domain, {ADVICE_SQL} AS recommendation FROM (SELECT portfolio_id, unnest([CASE WHEN sharpe_ratio < 0.6 THEN {{'priority': 'HIGH', 'domain': 'MODEL_TUNING'}} END, CASE WHEN abs(max_drawdown) > 0.2 THEN {{'priority': 'HIGH', 'domain': 'RISK_CONTROL'}} END,
      CASE WHEN ann_fixed_cost_bp > 100 OR ann_turnover > 6 THEN {{'priority': 'MEDIUM', 'domain': 'EXECUTION_COSTS'}} END, CASE WHEN risk_grade = 'HIGH' THEN {{'priority': 'CRITICAL', 'domain': 'PORTFOLIO_DELEVERAGING'}} END,
      CASE WHEN (SELECT bool_or(drifted) FROM dr) THEN {{'priority': 'HIGH', 'domain': 'MODEL_RETRAINING'}} END, CASE WHEN NOT (SELECT bool_and(passed) FROM ck) THEN {{'priority': 'CRITICAL', 'domain': 'DATA_PIPELINE'}} END]) AS x
      FROM ({SUM}) JOIN rg USING (portfolio_id)) q, LATERAL (SELECT q.x.priority AS priority, q.x.domain AS domain) WHERE priority IS NOT NULL""", ACT | RG | DRIFT | FEED))
def _(t):
    drift = monitoring.feature_drift(*halves(t), DF).agg(F.max("drifted").alias("drift_detected"))
    passed = quality.feed_report(feed(t)).select(c("passed").alias("quality_passed"))
    one = F.broadcast(drift.join(passed))
    inputs = backtest.summary(backtest_daily(t)).join(grade(t).select("portfolio_id", "risk_grade"), "portfolio_id").join(one)
    return insights.recommendations(inputs, ["portfolio_id"]).drop("rationale")


# -- execution costs -----------------------------------------------------------------------

TCA = {
    "ord": "SELECT l_orderkey * 10 + l_linenumber AS order_id, date, ticker, CASE WHEN l_returnflag = 'N' THEN 'BUY' ELSE 'SELL' END AS side, l_quantity * 20 AS qty, close AS limit_price FROM trades",
    "oc": "SELECT o.*, p.open, p.high, p.low, p.close, p.volume FROM ord o JOIN panel p USING (date, ticker)",
    "mf0": "SELECT *, least(qty, volume * 0.1::DOUBLE) AS fill_qty FROM oc",
    "mf": """SELECT *, 10 + fill_price * fill_qty * 0.001 AS commission FROM (SELECT *, close + CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * (half_spread + slippage) AS fill_price FROM (
        SELECT *, close * (0.0002 + 0.5 * 0.015 + 0.1 * sqrt(fill_qty / greatest(1, volume))) AS slippage, close * 0.00025 AS half_spread FROM mf0))""",
}


def orders(t):
    return t.trades().select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("order_id"), "date", "ticker",
        F.when(c("l_returnflag") == "N", "BUY").otherwise("SELL").alias("side"), (c("l_quantity") * 20.0).alias("qty"), c("close").alias("limit_price"))


def matched(t):
    return tca.with_candle(orders(t), t.panel())


@query("execution_market_fills", fin("order_id:i side:k fill_qty fill_price slippage half_spread commission", "SELECT * FROM mf", TCA))
def _(t):
    return tca.market_fills(matched(t)).select("order_id", "side", "fill_qty", "fill_price", "slippage", "half_spread", "commission")


@query("execution_limit_fills", fin("order_id:i side:k fill_qty fill_price commission", """SELECT order_id, side, fill_qty, limit_price AS fill_price, 10 + limit_price * fill_qty * 0.001 AS commission FROM mf0
    WHERE CASE WHEN side = 'BUY' THEN low <= limit_price ELSE high >= limit_price END""", TCA))
def _(t):
    return tca.limit_fills(matched(t)).select("order_id", "side", "fill_qty", "fill_price", "commission")


@query("execution_twap_slices", fin("slice:i n:i total_qty", "SELECT s AS slice, count(*) AS n, sum(qty / 5) AS total_qty FROM ord CROSS JOIN range(0, 5) x(s) GROUP BY 1", TCA))
def _(t):
    return tca.twap_slices(orders(t), 5).groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("total_qty"))


VW = TCA | {"lv": "SELECT ticker, 10 - k AS slice, volume / sum(volume) OVER (PARTITION BY ticker) AS profile_weight FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM panel) WHERE k <= 10"}


@query("execution_vwap_slices", fin("ticker:k slice:i n:i profile_weight qty:4", "SELECT ticker, slice, count(*) AS n, max(profile_weight) AS profile_weight, sum(qty * profile_weight) AS qty FROM ord JOIN lv USING (ticker) GROUP BY 1, 2", VW))
def _(t):
    return tca.vwap_slices(orders(t), t.panel(), 10).groupBy("ticker", "slice").agg(
        F.count(F.lit(1)).alias("n"), F.max("profile_weight").alias("profile_weight"), tidy(F.sum("qty"), 4).alias("qty"))


# every child slice meets the candle of its order
ROLLUP = VW | {"ch": "SELECT o.order_id, side, close, volume, o.qty * profile_weight AS q FROM oc o JOIN lv USING (ticker)",
               "cf": "SELECT *, least(q, volume * 0.1::DOUBLE) AS fq FROM ch",
               "cg": "SELECT *, close * (0.0002 + 0.5 * 0.015 + 0.1 * sqrt(fq / greatest(1, volume))) AS sl, close * 0.00025 AS hs FROM cf",
               "ci": "SELECT *, close + CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * (sl + hs) AS px FROM cg",
               "ru": "SELECT order_id, sum(fq) AS filled_qty, sum(px * fq) / sum(fq) AS avg_fill_price, sum(10 + px * fq * 0.001) AS total_commission, sum(sl * fq) AS total_slippage, count(*) AS n_fills FROM ci GROUP BY 1",
               "rp": """SELECT o.order_id, o.side, o.qty, o.close AS arrival_price, filled_qty, avg_fill_price, total_commission, total_slippage, n_fills, CASE WHEN filled_qty >= o.qty * (1 - 1e-12) THEN 'FILLED' WHEN filled_qty > 0 THEN 'PARTIALLY_FILLED' ELSE 'PENDING' END AS status,
                filled_qty / o.qty * 100 AS fill_rate_pct, CASE WHEN o.side = 'BUY' THEN 1 ELSE -1 END * (avg_fill_price - o.close) / o.close * 1e4 AS shortfall_bps FROM oc o JOIN ru USING (order_id)"""}
RU_SPEC = "order_id:i qty arrival_price filled_qty avg_fill_price total_commission:4 total_slippage:4 n_fills:i status:k"


def rolled(t):
    m = matched(t)
    fills = tca.market_fills(tca.vwap_slices(m, t.panel(), 10))
    return tca.roll_up(fills, m.select("order_id", "side", "qty", c("close").alias("arrival_price")))


@query("execution_roll_up", fin(RU_SPEC, "SELECT * FROM rp", ROLLUP))
def _(t):
    return rolled(t).drop("side").withColumns({"total_commission": tidy("total_commission", 4), "total_slippage": tidy("total_slippage", 4)})


@query("execution_report", fin("order_id:i fill_rate_pct shortfall_bps", "SELECT * FROM rp", ROLLUP))
def _(t):
    return tca.report(rolled(t)).select("order_id", "fill_rate_pct", "shortfall_bps")
