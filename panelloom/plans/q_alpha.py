"""Queries: universe, alpha evaluation."""

from pyspark.sql import functions as F

from panelloom.operators import alpha, features, universe
from panelloom.plans.oracle import avgrank, fin, pctrank, r
from panelloom.plans.registry import query

c = F.col


# -- universe -------------------------------------------------------------------------

@query("membership_snapshots", fin("snapshot_date:d ticker:k is_in:k", "SELECT * FROM members"))
def _(t):
    return t.membership()


@query("universe_point_in_time", fin("date:d ticker:k close", """
    SELECT p.date, p.ticker, p.close FROM panel p LEFT JOIN (
      SELECT d.date, max(snapshot_date) AS s FROM (SELECT DISTINCT date FROM panel) d LEFT JOIN snapdates ON snapshot_date <= d.date GROUP BY 1) q USING (date)
    LEFT JOIN members m ON m.snapshot_date = q.s AND m.ticker = p.ticker AND m.is_in
    LEFT JOIN (SELECT snapshot_date, bool_or(is_in) AS a FROM members GROUP BY 1) n ON n.snapshot_date = q.s
    WHERE m.ticker IS NOT NULL OR NOT coalesce(n.a, false)"""))
def _(t):
    return universe.members_at(t.panel().select("date", "ticker", "close"), t.membership())


@query("universe_sector_map", fin("date:d ticker:k sector:k", "SELECT date, ticker, coalesce(sector, 'Other') AS sector FROM panel LEFT JOIN smap USING (ticker)"))
def _(t):
    return universe.with_sector(t.panel(), t.sector_map()).select("date", "ticker", "sector")


@query("universe_benchmark_sectors", fin("sector:k benchmark_weight", "SELECT * FROM sbench"))
def _(t):
    return t.sector_benchmark()


@query("universe_min_history", fin("ticker:k n:i", "SELECT ticker, count(close) AS n FROM panel GROUP BY 1 HAVING count(close) >= 252"))
def _(t):
    return universe.enough_history(t.panel()).groupBy("ticker").agg(F.count("close").alias("n"))


@query("universe_sector_context", fin("sector:k date:d ctx_ret", """
    SELECT k.sector, cal.date, coalesce(s, 0) / k AS ctx_ret FROM (SELECT sector, count(DISTINCT ticker) AS k FROM rets JOIN smap USING (ticker) GROUP BY 1) k
    CROSS JOIN cal LEFT JOIN (SELECT sector, date, sum(ret) AS s FROM rets JOIN smap USING (ticker) GROUP BY 1, 2) d ON d.sector = k.sector AND d.date = cal.date"""))
def _(t):
    return universe.sector_context(t.panel(), t.sector_map())


@query("features_sector_residual", fin("date:d n:i m", """
    SELECT date, count(x) AS n, avg(x) AS m FROM (SELECT date, return_1m AS x FROM core) GROUP BY date"""))
def _(t):
    """Core features with the sector mean as context: momentum does not depend on it."""
    from panelloom.operators import features

    panel = universe.with_sector(t.panel(), t.sector_map())
    core = features.core_features(panel, universe.sector_context(t.panel(), t.sector_map()))
    return core.groupBy("date").agg(F.count("return_1m").alias("n"), F.avg("return_1m").alias("m"))


@query("universe_active_features", fin("feature:k n_valid:i active:k", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, count({f}) AS n_valid, count({f}) > 0 AS active FROM core" for f in
    features.CORE_COLUMNS)))
def _(t):
    return universe.active_columns(t.core(), features.CORE_COLUMNS)


@query("universe_traded_value", fin("date:d ticker:k adv_millions", "SELECT date, ticker, adv / 1e6 AS adv_millions FROM adv"))
def _(t):
    return universe.traded_value(t.panel()).select("date", "ticker", (c("adv") / 1e6).alias("adv_millions"))


# -- alpha evaluation -------------------------------------------------------------------

MIN = 5


def fwd_sql(hs):
    """Calendar-shifted forward returns per horizon."""
    return "SELECT h.h AS horizon, s.date, s.ticker, score, b.close / a.close - 1 AS fwd FROM scores s JOIN calpx a USING (date, ticker) " \
        f"CROSS JOIN (VALUES {', '.join(f'({h})' for h in hs)}) h(h) JOIN calpx b ON b.ticker = s.ticker AND b.idx = a.idx + h.h"


def ic_sql(src, keys="horizon, date", x="score", y="fwd"):
    return f"SELECT {keys}, sum(rx * ry) / nullif(sqrt(sum(rx * rx) * sum(ry * ry)), 0) AS ic, count(*) AS n FROM (SELECT *, {avgrank(x, keys)} - (count(*) OVER (PARTITION BY {keys}) + 1) / 2.0::DOUBLE AS rx, {avgrank(y, keys)} - (count(*) OVER (PARTITION BY {keys}) + 1) / 2.0::DOUBLE AS ry FROM {src}) GROUP BY {keys}"


IC = {"fwd": fwd_sql([21]), "ic0": ic_sql("fwd"), "ic": f"SELECT * FROM ic0 WHERE n >= {MIN} AND ic IS NOT NULL"}


def daily(t):
    return alpha.daily_ic(t.scores(), t.panel(), [21], MIN)


@query("alpha_daily_ic", fin("horizon:i date:d ic n:i", "SELECT * FROM ic", IC))
def _(t):
    return daily(t)


ROWSHIFT = {"seq": "SELECT date, ticker, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS idx FROM panel",
            "fwd": "SELECT 21 AS horizon, s.date, s.ticker, score, b.close / a.close - 1 AS fwd FROM scores s JOIN seq a USING (date, ticker) JOIN seq b ON b.ticker = s.ticker AND b.idx = a.idx + 21",
            "ic0": ic_sql("fwd"), "ic": f"SELECT * FROM ic0 WHERE n >= {MIN} AND ic IS NOT NULL"}


@query("alpha_daily_ic_row_shift", fin("horizon:i date:d ic n:i", "SELECT * FROM ic", ROWSHIFT))
def _(t):
    return alpha.daily_ic(t.scores(), t.panel(), [21], MIN, calendar_shift=False)


STATS = """SELECT avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS ic_tstat,
    avg((ic > 0)::INT) AS pct_positive, count(ic) AS n_dates FROM {0}"""
FLAGS = "SELECT *, ic_mean < 0.03 OR ic_tstat < 2 AS weak_alpha, ic_mean > 0.04 AND ic_tstat > 2.5 AS institutional_grade FROM st"


@query("alpha_ic_stats", fin("ic_mean ic_std ic_tstat pct_positive n_dates:i weak_alpha:k institutional_grade:k", FLAGS,
                             ROWSHIFT | {"st": STATS.format("ic")}))
def _(t):
    return alpha.ic_stats(alpha.daily_ic(t.scores(), t.panel(), [21], MIN, calendar_shift=False))


@query("alpha_rolling_ic", fin("horizon:i date:d ic rolling_ic", f"SELECT horizon, date, ic, {r('avg', 'ic', 126, 63, part='horizon')} AS rolling_ic FROM ic", ROWSHIFT))
def _(t):
    return alpha.rolling_ic(alpha.daily_ic(t.scores(), t.panel(), [21], MIN, calendar_shift=False))


PERIODS = [("early", "1995-01-01", "1996-12-31"), ("middle", "1997-01-01", "1999-12-31"), ("late", "2000-01-01", "2001-12-31")]
PERIOD_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', DATE '{s}', DATE '{e}')" for n, s, e in PERIODS) + ") v(period, s, e)"


@query("alpha_sub_period_ic", fin("period:k ic_mean profitable:k", """
    SELECT period, coalesce(avg(ic), 0) AS ic_mean, coalesce(avg(ic), 0) > 0 AS profitable FROM per LEFT JOIN ic ON date BETWEEN s AND e GROUP BY 1""",
    ROWSHIFT | {"per": PERIOD_SQL}))
def _(t):
    return alpha.sub_period_ic(alpha.daily_ic(t.scores(), t.panel(), [21], MIN, calendar_shift=False), PERIODS)


SPREAD = {
    "rk": f"""SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS down, row_number() OVER (PARTITION BY date ORDER BY score, ticker) AS up,
        count(*) OVER (PARTITION BY date) AS n FROM scores""",
    "legs": f"""SELECT date AS start, ticker, side, 1.0::DOUBLE / greatest(1, floor(n * 0.1::DOUBLE)) AS weight FROM rk CROSS JOIN (VALUES (1), (-1)) v(side)
        WHERE n >= {MIN} AND CASE WHEN side = 1 THEN down ELSE up END <= greatest(1, floor(n * 0.1::DOUBLE))""",
    "per0": """SELECT date AS start, idx AS s, coalesce(lead(idx) OVER (ORDER BY date), (SELECT max(idx) FROM cal)) AS e FROM (SELECT DISTINCT date FROM scores) JOIN cal USING (date)""",
    "per": "SELECT *, row_number() OVER (ORDER BY start) AS seq FROM per0 WHERE start IN (SELECT start FROM legs)",
    "ls": "SELECT l.ticker, weight, seq FROM legs l JOIN per USING (start) WHERE side = 1",
    "tov": """SELECT seq, sum(d) AS turnover FROM (SELECT p.seq, u.ticker, abs(coalesce(a.weight, 0) - coalesce(b.weight, 0)) AS d FROM per p
        JOIN (SELECT seq, ticker FROM ls UNION SELECT seq + 1, ticker FROM ls) u USING (seq)
        LEFT JOIN ls a ON a.seq = p.seq AND a.ticker = u.ticker LEFT JOIN ls b ON b.seq = p.seq - 1 AND b.ticker = u.ticker) GROUP BY seq""",
    "spread": """SELECT p.start, d.date, sum(side * weight * coalesce(ret, 0)) AS spread, max(CASE WHEN d.idx = p.e THEN (turnover + 0.02) * 0.0015 ELSE 0 END) AS cost
        FROM legs l JOIN per p USING (start) JOIN cal d ON d.idx BETWEEN p.s AND p.e JOIN tov USING (seq) LEFT JOIN rets r ON r.date = d.date AND r.ticker = l.ticker GROUP BY 1, 2""",
}


def spread(t):
    return alpha.decile_spread(t.scores(), t.panel(), t.close_returns(), MIN)


@query("alpha_decile_spread", fin("start:d date:d spread cost net", "SELECT *, spread - cost AS net FROM spread", SPREAD))
def _(t):
    return spread(t)


@query("alpha_decile_stats", fin("sharpe max_drawdown n_days:i", """
    SELECT avg(net) / stddev_samp(net) * sqrt(252.0) AS sharpe, min(eq / mx - 1) AS max_drawdown, count(*) AS n_days FROM (
      SELECT *, max(eq) OVER (ORDER BY start, date) AS mx FROM (SELECT *, product(1 + net) OVER (ORDER BY start, date) AS eq FROM (SELECT *, spread - cost AS net FROM spread)))""", SPREAD))
def _(t):
    from panelloom.functions import stage

    return alpha.series_stats(stage(spread(t), "spread"), [], ["start", "date"], "net")


@query("alpha_decay_pooled", fin("horizon:i ic n:i", "SELECT * FROM d WHERE n > 100",
                                 {"fwd": fwd_sql([1, 5, 10, 21, 63, 126]), "d": ic_sql("fwd", "horizon")}))
def _(t):
    return alpha.ic_decay_pooled(t.scores(), t.panel())


@query("alpha_decay_daily", fin("horizon:i ic_mean ic_std n_obs:i", f"""SELECT horizon, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, count(ic) AS n_obs
    FROM ic0 WHERE n >= {MIN} AND ic IS NOT NULL GROUP BY 1""", {"fwd": fwd_sql([5, 10, 21, 42, 63]), "ic0": ic_sql("fwd")}))
def _(t):
    return alpha.ic_decay_daily(t.scores(), t.panel(), min_names=MIN)


@query("alpha_decay_shifted", fin("horizon:i mean_ic n_obs:i", """SELECT horizon, avg(ic) AS mean_ic, count(*) AS n_obs FROM ic0 WHERE n >= 6 GROUP BY 1""", {
    "fwd": """SELECT h AS horizon, s.date, s.ticker, score, r.ret AS fwd FROM scores s JOIN cal a USING (date) CROSS JOIN (VALUES (1), (5), (10), (21)) v(h)
        JOIN cal b ON b.idx = a.idx + h JOIN rets r ON r.date = b.date AND r.ticker = s.ticker AND ret IS NOT NULL""",
    "ic0": ic_sql("fwd")}))
def _(t):
    return alpha.ic_decay_shifted(t.scores(), t.close_returns(), t.panel())


@query("alpha_compare_experiments", fin("experiment:k ic_mean ic_std ic_tstat pct_positive n_dates:i weak_alpha:k institutional_grade:k", FLAGS, ROWSHIFT | {
    "mom": f"SELECT date, ticker, {pctrank('return_1m')} AS score FROM core WHERE return_1m IS NOT NULL",
    "fwd2": ROWSHIFT["fwd"].replace("FROM scores s", "FROM mom s"), "ic2": ic_sql("fwd2"),
    "st": f"SELECT 'reversion' AS experiment, * FROM ({STATS.format('ic')}) UNION ALL SELECT 'momentum', * FROM ({STATS.format(f'(SELECT * FROM ic2 WHERE n >= {MIN} AND ic IS NOT NULL)')})"}))
def _(t):
    from panelloom.functions import percent_rank

    mom = t.core().select("date", "ticker", "return_1m").dropna()
    mom = percent_rank(mom, ["date"], "return_1m", "score").select("date", "ticker", "score")
    ic = lambda s: alpha.daily_ic(s, t.panel(), [21], MIN, calendar_shift=False)
    return alpha.compare_experiments({"reversion": ic(t.scores()), "momentum": ic(mom)})
