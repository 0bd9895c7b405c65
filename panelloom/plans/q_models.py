"""Queries: models, sources and sinks, streams."""

import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from panelloom.functions import rank_columns, stage, tidy
from panelloom.functions.staging import staging_root
from panelloom.operators import backtest, features, labels, models, portfolio, universe, xsection
from panelloom.plans.oracle import fin, pctrank, r
from panelloom.plans.q_backtest import MONTH, backtest_daily
from panelloom.plans.registry import query
from panelloom.sources import io
from panelloom.sources.tables import Tables, staged
from panelloom.streaming import streams

c = F.col
FEATURES = ["return_1m", "bollinger_distance", "volume_shock", "volatility_regime"]


@query("model_walk_forward_splits", fin("split_id:i pred_date:d train_start:d train_end:d train_rows:i", """
    SELECT row_number() OVER (ORDER BY pred_date) AS split_id, * FROM (SELECT pred_date, train_start, train_end, count(*) AS train_rows FROM (
      SELECT pred_date, (pred_date - INTERVAL 70 DAY)::DATE AS train_end, ((pred_date - INTERVAL 70 DAY) - INTERVAL 3 YEAR)::DATE AS train_start FROM (
        SELECT DISTINCT (SELECT min(date) FROM cal WHERE date >= tick) AS pred_date FROM (SELECT tick::DATE AS tick FROM range(DATE '1990-01-01', DATE '2010-01-01', INTERVAL 1 MONTH) x(tick))
        WHERE tick >= (SELECT min(date) + INTERVAL 3 YEAR FROM cal) AND tick <= (SELECT max(date) FROM cal))) JOIN panel ON date BETWEEN train_start AND train_end GROUP BY 1, 2, 3 HAVING count(*) >= 500)"""))
def _(t):
    return models.walk_forward_splits(t.panel())


@query("model_time_split", fin("role:k first:d last:d n:i", """SELECT role, min(date) AS first, max(date) AS last, count(*) AS n FROM (
    SELECT p.date, CASE WHEN idx <= (SELECT floor(count(*) * 0.8::DOUBLE) FROM cal) THEN 'train' ELSE 'validation' END AS role FROM panel p JOIN cal USING (date)) GROUP BY 1"""))
def _(t):
    return models.time_split(t.panel()).groupBy("role").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("n"))


def cv_sql(expanding):
    a = "1" if expanding else "pos - head + 1"
    return f"""SELECT fold, min(date) FILTER (idx BETWEEN {a} AND pos) AS train_start, max(date) FILTER (idx BETWEEN {a} AND pos) AS train_end, sum(n) FILTER (idx BETWEEN {a} AND pos) AS train_rows,
        min(date) FILTER (idx > pos AND idx <= e) AS test_start, max(date) FILTER (idx > pos AND idx <= e) AS test_end, sum(n) FILTER (idx > pos AND idx <= e) AS test_rows FROM (
        SELECT k + 1 AS fold, head, head + k * step AS pos, least(head + k * step + step, m - 1) AS e FROM (SELECT count(*) AS m, floor(count(*) * 0.4::DOUBLE)::INT AS head, floor(count(*) * 0.6::DOUBLE / 5)::INT AS step FROM cal) CROSS JOIN range(0, 5) r(k))
        CROSS JOIN (SELECT date, idx, count(*) AS n FROM panel JOIN cal USING (date) GROUP BY 1, 2) GROUP BY fold"""


CV_SPEC = "fold:i train_start:d train_end:d train_rows:i test_start:d test_end:d test_rows:i"


@query("model_cv_expanding", fin(CV_SPEC, cv_sql(True)))
def _(t):
    return models.cv_folds(t.panel())


@query("model_cv_sliding", fin(CV_SPEC, cv_sql(False)))
def _(t):
    return models.cv_folds(t.panel(), expanding=False)


# -- scores and confidence over given member scores -----------------------------------------

MEMBERS = ["m0", "m1", "m2"]
MEM = {"mem": "SELECT date, ticker, " + ", ".join(f"{pctrank(f)} AS m{i}" for i, f in enumerate(FEATURES[:3])) + " FROM core WHERE " + " AND ".join(f"{f} IS NOT NULL" for f in FEATURES[:3]),
       "tg": f"SELECT date, ticker, {pctrank('f')} AS target FROM (SELECT date, ticker, lead(close, 21) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS f FROM panel)",
       "pr": "SELECT m.*, (m0 + m1 + m2) / 3 AS prediction, target FROM mem m JOIN tg USING (date, ticker)",
       "ds": "SELECT *, sqrt((pow(m0 - prediction, 2) + pow(m1 - prediction, 2) + pow(m2 - prediction, 2)) / 2) AS dispersion FROM pr"}


@staged
def member_table(t: Tables):
    df = features.core_features(t.panel(), only=FEATURES[:3]).select("date", "ticker", *FEATURES[:3]).dropna()
    df = rank_columns(df.select("date", "ticker", *[c(f).alias(m) for f, m in zip(FEATURES, MEMBERS)]), ["date"], MEMBERS, like=t.panel())
    y = labels.target_panel(t.panel(), 21).select("date", "ticker", "target")
    mean = (c("m0") + c("m1") + c("m2")) / 3.0
    return df.select("date", "ticker", *MEMBERS).join(y, ["date", "ticker"]).select("date", "ticker", *MEMBERS, mean.alias("prediction"), "target")


@query("model_score_zscore", fin("date:d ticker:k score", "SELECT date, ticker, (prediction - avg(prediction) OVER (PARTITION BY date)) / (stddev_samp(prediction) OVER (PARTITION BY date) + 1e-8) AS score FROM pr", MEM))
def _(t):
    return models.normalize_scores(member_table(t), method="zscore").select("date", "ticker", "score")


@query("model_scores_at_dates", fin("date:d ticker:k score", "SELECT * FROM scores WHERE date IN (SELECT rebal_date FROM weights)"))
def _(t):
    return models.scores_at(t.scores(), t.weights().select(c("rebal_date").alias("date")))


@query("model_smooth_scores", fin("rebal_date:d ticker:k score", """SELECT rebal_date, s.ticker, avg(score) AS score FROM (SELECT DISTINCT rebal_date FROM weights) w JOIN sc a ON a.date = w.rebal_date
    JOIN sc b ON b.idx BETWEEN a.idx - 4 AND a.idx JOIN scores s ON s.date = b.date JOIN uni u ON u.date = s.date AND u.ticker = s.ticker GROUP BY 1, 2""", {
    "sc": "SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM scores)",
    "uni": """SELECT p.date, p.ticker FROM panel p LEFT JOIN (SELECT d.date, max(snapshot_date) AS s FROM (SELECT DISTINCT date FROM panel) d LEFT JOIN snapdates ON snapshot_date <= d.date GROUP BY 1) q USING (date)
        LEFT JOIN members m ON m.snapshot_date = q.s AND m.ticker = p.ticker AND m.is_in LEFT JOIN (SELECT snapshot_date, bool_or(is_in) AS a FROM members GROUP BY 1) n ON n.snapshot_date = q.s WHERE m.ticker IS NOT NULL OR NOT coalesce(n.a, false)"""}))
def _(t):
    members = universe.members_at(t.panel().select("date", "ticker"), t.membership())
    return models.smooth_scores(t.scores(), t.weights(), members)


@query("model_dispersion", fin("date:d ticker:k dispersion", "SELECT date, ticker, dispersion FROM ds", MEM))
def _(t):
    return models.dispersion(member_table(t), MEMBERS).select("date", "ticker", "dispersion")


@query("model_confidence_tiers", fin("tier:k n:i", "SELECT CASE WHEN dispersion >= hi THEN 'LOW' WHEN dispersion <= lo THEN 'HIGH' ELSE 'MEDIUM' END AS tier, count(*) AS n FROM (SELECT *, quantile_cont(dispersion, 0.25) OVER () AS lo, quantile_cont(dispersion, 0.75) OVER () AS hi FROM ds) GROUP BY 1", MEM))
def _(t):
    return models.confidence_tiers(models.dispersion(member_table(t), MEMBERS)).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


CONF = MEM | {"rs": "SELECT abs(target - prediction) AS r FROM pr WHERE date < DATE '1998-01-01' AND target IS NOT NULL AND prediction IS NOT NULL",
              "ro": "SELECT r, row_number() OVER (ORDER BY r) AS k, count(*) OVER () AS n FROM rs",
              "rq": "SELECT lo + (hi - lo) * (h - floor(h)) AS q FROM (SELECT max(h) AS h, max(r) FILTER (k = floor(h) + 1) AS lo, max(r) FILTER (k = least(floor(h) + 2, n)) AS hi FROM (SELECT *, (n - 1) * least(1.0, 0.9::DOUBLE * (1 + 1.0::DOUBLE / n)) AS h FROM ro))"}


@query("model_conformal_interval", fin("date:d ticker:k lower upper width", "SELECT date, ticker, prediction - q AS lower, prediction + q AS upper, 2 * q AS width FROM pr CROSS JOIN rq WHERE date >= DATE '1998-01-01'", CONF))
def _(t):
    df, cut = member_table(t), F.lit("1998-01-01").cast("date")
    return models.conformal(df.where(c("date") < cut), df.where(c("date") >= cut)).select("date", "ticker", "lower", "upper", "width")


@query("model_confidence_report")
def _(t):
    df, cut = member_table(t), F.lit("1998-01-01").cast("date")
    return models.confidence_report(df.where(c("date") >= cut), MEMBERS, df.where(c("date") < cut))


SH = {"sf": " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS v, date < DATE '1998-01-01' AS old FROM core" for f in FEATURES),
      "ms": "SELECT feature, abs(avg(v) FILTER (NOT old) - avg(v) FILTER (old)) / nullif(stddev_samp(v) FILTER (old), 0) AS shift FROM sf GROUP BY 1"}


def shifts(t):
    core, cut = t.core(), F.lit("1998-01-01").cast("date")
    return models.mean_shift(core.where(c("date") < cut), core.where(c("date") >= cut), FEATURES)


@query("model_mean_shift", fin("feature:k shift", "SELECT * FROM ms", SH))
def _(t):
    return shifts(t)


@query("model_mean_shift_verdict", fin("mean_shift drifted:k top_features:k", "SELECT avg(shift) AS mean_shift, avg(shift) > 0.15 AS drifted, array_to_string(list(feature ORDER BY shift DESC, feature DESC)[1:5], ',') AS top_features FROM ms", SH))
def _(t):
    return models.mean_shift_verdict(shifts(t))


# -- sources and sinks -----------------------------------------------------------------------

def scratch(t, name):
    return os.path.join(staging_root(t.spark), f"{name}-{uuid.uuid4().hex}")


@query("source_panel_range", fin("date:d ticker:k close volume", "SELECT date, ticker, close, volume FROM panel WHERE date BETWEEN DATE '1996-03-01' AND DATE '1998-02-15'"))
def _(t):
    path = scratch(t, "panel")
    io.write_panel(t.panel(), path)
    return io.read_panel(t.spark, path, start="1996-03-01", end="1998-02-15").select("date", "ticker", "close", "volume")


def vendor_wide(t):
    """Country highs as vendor columns ``<country>.NS|Field``: one per nation and field."""
    p = t.panel().join(t.sector_map(), "ticker")
    names = [r_.n_name for r_ in t.raw("nation").select("n_name").orderBy("n_name").collect()]
    pick = lambda n, f, fn: fn(F.when(c("country") == n, c(f)))
    return p.groupBy("date").agg(*[
        pick(n, f, F.sum if f == "volume" else F.max).alias(f"{n}.NS|{f.title()}") for n in names for f in ("open", "high", "low", "close", "volume")])


@query("source_vendor_wide_to_long", fin("date:d ticker:k open high low close volume", """SELECT date, country AS ticker, max(open) AS open, max(high) AS high, max(low) AS low, max(close) AS close, sum(volume) AS volume
    FROM panel JOIN smap USING (ticker) GROUP BY 1, 2"""))
def _(t):
    return io.wide_to_long(vendor_wide(t))


@query("source_macro_symbol", fin("date:d close", "SELECT date, close FROM vix"))
def _(t):
    both = t.vix().withColumn("symbol", F.lit("VIX")).unionByName(t.index_prices().select("date", "close", "symbol"))
    return io.read_symbol(both, "VIX")


@query("source_concat_batches", fin("n:i n_close:i n_roe:i", "SELECT count(*) AS n, count(close) AS n_close, 0 AS n_roe FROM panel"))
def _(t):
    p = t.panel()
    early, late = p.where("year(date) < 1998"), p.where("year(date) >= 1998").drop("volume")
    return io.concat_batches(early, late).agg(F.count(F.lit(1)).alias("n"), F.count("close").alias("n_close"), F.count("roe").alias("n_roe"))


@query("source_dataset_fingerprint")
def _(t):
    return io.fingerprint(t.panel()).select("row_count", c("x").alias("row_hash_xor"), c("s").cast("string").alias("row_hash_sum"))


@query("source_versions", fin("position:i dataset_name:k row_count:i n_columns:i loaded_rows:i", """SELECT 1 AS position, 'vix' AS dataset_name, count(*) AS row_count, 2 AS n_columns, count(*) AS loaded_rows FROM vix
    UNION ALL SELECT 2, 'panel', count(*), 7, count(*) FROM panel"""))
def _(t):
    root = scratch(t, "store")
    day = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
    io.create_version(t.panel(), "panel", root, "1995-01-01", "2001-12-31", day(1))
    io.create_version(t.vix(), "vix", root, "1995-01-01", "2001-12-31", day(2))
    listed = io.list_versions(t.spark, root).collect()
    loaded = [io.load_version(t.spark, root, v.version_id).select(F.lit(i + 1).alias("position")) for i, v in enumerate(listed)]
    n = loaded[0].unionByName(loaded[1]).groupBy("position").agg(F.count(F.lit(1)).alias("loaded_rows"))
    head = t.spark.createDataFrame([(i + 1, v.dataset_name, v.row_count, len(v.columns)) for i, v in enumerate(listed)],
                                   "position int, dataset_name string, row_count bigint, n_columns int")
    return head.join(n, "position")


@query("sink_reports", fin("portfolio_id:i n:i drawdown_sum months:i", f"""SELECT portfolio_id, count(*) AS n, sum(drawdown) AS drawdown_sum, max(m) AS months FROM bt JOIN (
    SELECT portfolio_id, count(*) AS m FROM ({MONTH}) GROUP BY 1) USING (portfolio_id) GROUP BY 1"""))
def _(t):
    daily = backtest_daily(t)
    paths = io.export_report(daily, backtest.monthly_returns(daily), backtest.summary(daily), scratch(t, "report"))
    read = lambda k, s: t.spark.read.schema(s).option("header", True).csv(paths[k])
    d = read("drawdown_series", "portfolio_id int, date date, drawdown double").groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n"), F.sum("drawdown").alias("drawdown_sum"))
    m = read("monthly_returns", "portfolio_id int, month date, monthly_return double").groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("months"))
    return d.join(m, "portfolio_id")


@query("sink_orders_csv", fin("portfolio_id:i n:i shares:i", """SELECT portfolio_id, count(*) AS n, sum(floor(weight * 1e5 / price)) AS shares FROM (SELECT w.* FROM weights w JOIN (SELECT portfolio_id, max(rebal_date) AS rebal_date FROM weights GROUP BY 1) USING (portfolio_id, rebal_date))
    JOIN (SELECT ticker, arg_max(close, date) AS price FROM panel GROUP BY 1) USING (ticker) GROUP BY 1"""))
def _(t):
    path = scratch(t, "orders")
    orders = portfolio.order_list(t.weights(), t.panel())
    orders.write.option("header", True).csv(path)
    back = t.spark.read.schema(orders.schema).option("header", True).csv(path)
    return back.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n"), F.sum("shares").alias("shares"))


RUNS = {"rl": "SELECT * FROM (SELECT user_id AS run_id, event_id AS seq, value AS val_ic, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1"}


@staged
def run_log(t: Tables):
    path = scratch(t, "runs")
    io.append_runs(t.raw("events").select(c("user_id").alias("run_id"), c("event_id").alias("seq"), c("value").alias("val_ic")), path)
    return t.spark.read.schema("run_id bigint, seq bigint, val_ic double").json(path)


@query("model_run_log", fin("run_id:i seq:i val_ic", "SELECT * FROM rl", RUNS))
def _(t):
    return models.run_log_latest(run_log(t))


@query("model_champion", fin("version_id:i val_ic is_champion:k", "SELECT run_id AS version_id, val_ic, run_id = (SELECT arg_max(run_id, (val_ic, run_id)) FROM rl) AS is_champion FROM rl", RUNS))
def _(t):
    v = stage(models.run_log_latest(run_log(t)).select(c("run_id").alias("version_id"), "val_ic"), "versions")
    best = v.agg(F.max(F.struct("val_ic", "version_id"))["version_id"].alias("best"))
    return models.promote(v.join(F.broadcast(best)), c("best")).drop("best").orderBy(c("val_ic").desc())


# -- streams -----------------------------------------------------------------------------------

def event_stream(t):
    raw = t.raw("events")
    return t.spark.readStream.schema(raw.schema).option("pathGlobFilter", "events.parquet").parquet(t.path).withColumn("ts", c("ts").cast("timestamp"))


def alert_stream(t):
    v = c("value")
    return event_stream(t).select(
        F.lit("panel").alias("service"), "event_id", "ts", F.when(v > 150, "CRITICAL").when(v > 75, "WARNING").otherwise("INFO").alias("severity"),
        c("event_type").alias("category"), F.concat(F.lit("m"), (c("user_id") % 3).cast("string")).alias("metric"))


@query("stream_alert_throttle")
def _(t):
    s = streams.throttle_stream(alert_stream(t), hourly_cap=12)
    return streams.run_to_table(s, scratch(t, "fired"), scratch(t, "fired-state")).select("event_id", "key")


@query("stream_operations", fin("window_start:k operation:k calls:i errors:i error_rate mean_ms max_ms", """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, operation, count(*) AS calls, sum((NOT success)::INT) AS errors, avg((NOT success)::INT) AS error_rate, avg(latency_ms) AS mean_ms, max(latency_ms) AS max_ms
    FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) AS w FROM ops) WHERE w + INTERVAL 5 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM ops) GROUP BY w, operation"""))
def _(t):
    log = event_stream(t).select(
        "ts", F.concat(F.lit("op_"), (c("user_id") % 10).cast("string")).alias("operation"), (c("value") * 10.0).alias("latency_ms"),
        (c("event_type") != "error").alias("success"))
    df = streams.run_to_table(streams.operations_stream(log), scratch(t, "ops"), scratch(t, "ops-state"))
    return df.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "operation", "calls", "errors", "error_rate", "mean_ms", "max_ms")


@query("stream_feed_quality", fin("check_name:k value passed:k", """SELECT 'row_count' AS check_name, count(*)::DOUBLE AS value, count(*) >= 10 AS passed FROM events UNION ALL SELECT 'missing_values', avg((value IS NULL)::INT), avg((value IS NULL)::INT) <= 0.05 FROM events
    UNION ALL SELECT 'outliers', sum((abs(value - m) / (s + 1e-8) > 5)::INT)::DOUBLE / count(*), sum((abs(value - m) / (s + 1e-8) > 5)::INT)::DOUBLE / count(*) < 0.01 FROM (SELECT value, avg(value) OVER () AS m, stddev_samp(value) OVER () AS s FROM events)
    UNION ALL SELECT 'staleness', DATE '2024-01-31' - max(ts)::DATE, DATE '2024-01-31' - max(ts)::DATE <= 3 FROM events UNION ALL SELECT 'duplicates', count(*) - count(DISTINCT event_id), count(*) = count(DISTINCT event_id) FROM events
    UNION ALL SELECT 'constant_columns', (stddev_samp(value) < 1e-10)::INT, NOT stddev_samp(value) < 1e-10 FROM events"""))
def _(t):
    out = scratch(t, "quality")
    q = streams.quality_stream(event_stream(t), ["value"], ["event_id"], "2024-01-31", out, scratch(t, "quality-state"), date="ts")
    q.awaitTermination()
    return t.spark.read.parquet(out).select(c("check").alias("check_name"), "value", "passed")
