"""Queries: features, cross-sectional transforms, labels."""

from pyspark.sql import functions as F

from panelloom.operators import features, labels, xsection
from panelloom.plans.oracle import corr, fin, lag, lead, pctrank, r
from panelloom.plans.registry import ORACLES, query

c = F.col
CORE = features.CORE_COLUMNS
LIVE = CORE[:11]
CORE_SPEC = "date:d ticker:k " + " ".join(CORE)


def context(t):
    return t.market().withColumnRenamed("mkt_ret", "ctx_ret")


def core_rows(t):
    """Core features for one reader, not staged: whole instruments in date order."""
    return features.core_features(t.panel(), context(t))


@query("features_core", fin("date:d ticker:k close " + " ".join(CORE), "SELECT * FROM core"))
def _(t):
    return core_rows(t)


@query("features_core_no_context", fin(
    "date:d ticker:k residual_momentum idiosyncratic_volatility",
    f"SELECT date, ticker, {lag('m')} AS residual_momentum, {lag('s')} AS idiosyncratic_volatility FROM "
    f"(SELECT date, ticker, close / {lag('close', 21)} - 1 AS m, {r('stddev_samp', 'ret', 20)} AS s FROM rets)"))
def _(t):
    return features.core_features(t.panel()).select("date", "ticker", "residual_momentum", "idiosyncratic_volatility")


FAMILY_SQL = {
    "Momentum": ("core1", {}, {}),
    "Quality": (
        "q0", {"q0": f"""SELECT *, -{r('stddev_samp', 'ret', 126)} AS earnings_stability,
            -{r('avg', '((high-low)/close)', 21)} AS gross_margin, {lag('ret')} AS ret1,
            count(ret) OVER (PARTITION BY ticker ORDER BY date ROWS 20 PRECEDING) AS n21 FROM rets""",
               "q1": """SELECT *, CASE WHEN n21 = 21 THEN covar_samp(ret, ret1) OVER w / nullif(stddev_samp(ret) OVER w * stddev_samp(ret1) OVER w, 0) END AS accruals_ratio,
            NULL::DOUBLE AS roe, NULL::DOUBLE AS roa, NULL::DOUBLE AS earnings_growth FROM q0
            WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)"""}, "q1"),
    "Value": ("v1", {"v0": f"""SELECT *, close / {r('avg', 'close', 252)} AS pe_proxy, close / {r('avg', 'close', 756)} AS pb_proxy,
            close / {r('max', 'close', 252)} - 1 AS distance_52w_high, close / {r('min', 'close', 252)} - 1 AS distance_52w_low,
            (close - {r('avg', 'close', 504)}) / {r('avg', 'close', 504)} AS price_to_trend FROM panel""",
                     "v1": "SELECT *, 1 / pe_proxy AS earnings_yield FROM v0"}, "v1"),
    "Growth": ("g0", {"g0": f"""SELECT *, close / {lag('close', 21)} - 1 - (close / {lag('close', 63)} - 1) / 3 AS price_acceleration,
            {r('avg', 'volume', 21)} / {r('avg', 'volume', 126)} - 1 AS volume_growth_1m,
            {r('avg', 'volume', 63)} / {r('avg', 'volume', 126)} - 1 AS volume_growth_3m,
            {r('avg', '(close*volume)', 21)} / {r('avg', '(close*volume)', 126)} - 1 AS revenue_proxy_growth,
            close / {r('max', 'close', 252)} - 1 AS expansion_breakout FROM panel"""}, "g0"),
    "Liquidity": ("l1", {"l0": f"""SELECT *, {r('avg', '(abs(ret)/(close*volume))', 21)} * 1e6 AS amihud_illiquidity,
            volume / {r('avg', 'volume', 63)} AS turnover_ratio,
            -({r('stddev_samp', 'volume', 21)} / {r('avg', 'volume', 21)}) AS volume_consistency,
            {r('avg', '(ln(high/low))', 21)} AS hl_spread_proxy FROM rets""",
                         "l1": f"""SELECT *, -(amihud_illiquidity - {r('avg', 'amihud_illiquidity', 252)}) / nullif({r('stddev_samp', 'amihud_illiquidity', 252)}, 0) AS z1,
            -(hl_spread_proxy - {r('avg', 'hl_spread_proxy', 252)}) / nullif({r('stddev_samp', 'hl_spread_proxy', 252)}, 0) AS z2,
            (turnover_ratio - {r('avg', 'turnover_ratio', 252)}) / nullif({r('stddev_samp', 'turnover_ratio', 252)}, 0) AS z3,
            (max(amihud_illiquidity) OVER (PARTITION BY ticker) IS NOT NULL)::INT + (max(hl_spread_proxy) OVER (PARTITION BY ticker) IS NOT NULL)::INT
              + (max(turnover_ratio) OVER (PARTITION BY ticker) IS NOT NULL)::INT AS usable FROM l0""",
                         "l2": """SELECT *, CASE WHEN usable >= 2 THEN (coalesce(z1,0) + coalesce(z2,0) + coalesce(z3,0)) /
            nullif((z1 IS NOT NULL)::INT + (z2 IS NOT NULL)::INT + (z3 IS NOT NULL)::INT, 0) END AS liquidity_score FROM l1"""}, "l2"),
    "Volatility": ("vo1", {"vo0": f"""SELECT *, {r('stddev_samp', 'ret', 20)} AS sd20, {r('stddev_samp', 'ret', 60)} AS sd60,
            sqrt({r('avg', '(least(ret,0.0)*least(ret,0.0)+0*ret)', 60)}) * sqrt(252.0) AS downside_deviation,
            {r('avg', '(sqrt(ln(high/low)*ln(high/low)/(4*ln(2.0))))', 20)} * sqrt(252.0) AS parkinson_vol,
            ret - b60 * cr AS resid FROM prep""",
                           "vo1": f"""SELECT *, sd20 * sqrt(252.0) AS realized_vol_20d, sd60 * sqrt(252.0) AS realized_vol_60d,
            {r('stddev_samp', 'sd20', 60)} AS vol_of_vol,
            CASE WHEN np > 60 THEN {r('stddev_samp', 'resid', 60)} ELSE sd60 END * sqrt(252.0) AS idio_volatility FROM vo0"""}, "vo1"),
    "Macro": ("m1", {"m0": "SELECT *, coalesce(cr, 0.0) AS mk FROM prep",
                     "m1": f"""SELECT *, CASE WHEN count(ret) OVER w >= 60 THEN covar_samp(ret, mk) OVER w / nullif(var_samp(mk) OVER w, 0) END AS market_beta,
            CASE WHEN count(ret) OVER w >= 60 THEN covar_samp(ret, mk) OVER w / nullif(stddev_samp(ret) OVER w * stddev_samp(mk) OVER w, 0) END AS macro_correlation,
            coalesce({r('stddev_samp', 'ret', 20)} > 1.5 * {r('stddev_samp', 'ret', 252)}, false)::INT::DOUBLE AS vix_regime,
            coalesce(close > {r('avg', 'close', 200)}, false)::INT::DOUBLE AS above_200dma FROM m0
            WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING)""",
                     "m2": "SELECT *, 0.5 * above_200dma - 0.5 * vix_regime AS macro_regime_score FROM m1"}, "m2"),
    "Sentiment": ("s2", {"s0": f"""SELECT *, CASE WHEN ret IS NOT NULL THEN sum(volume * sign(ret)) OVER (PARTITION BY ticker ORDER BY date) END AS obv,
            close - {lag('close')} AS delta, (high + low + close) / 3 AS typ FROM rets""",
                         "s1": f"""SELECT *, {lag('typ')} AS typ1, CASE WHEN delta IS NOT NULL THEN greatest(delta, 0.0) END AS gain,
            CASE WHEN delta IS NOT NULL THEN -least(delta, 0.0) END AS loss FROM s0""",
                         "s2": """SELECT *, CASE WHEN typ > typ1 THEN typ * volume ELSE 0.0 END AS up, CASE WHEN typ < typ1 THEN typ * volume ELSE 0.0 END AS down FROM s1""",
                         "s3": f"""SELECT *, (obv - {r('avg', 'obv', 21)}) / nullif(abs({r('avg', 'obv', 21)}), 0) AS obv_trend,
            ({r('max', 'high', 14)} - close) / nullif({r('max', 'high', 14)} - {r('min', 'low', 14)}, 0) * -100 AS williams_pct_r,
            100 - 100 / (1 + {r('avg', 'gain', 14)} / nullif({r('avg', 'loss', 14)}, 0)) AS rsi_14,
            100 - 100 / (1 + {r('sum', 'up', 14)} / nullif({r('sum', 'down', 14)}, 0)) AS money_flow_index,
            {r('avg', '(((close-low)-(high-close))/(high-low))', 21)} AS close_location_value FROM s2"""}, "s3"),
    "Alternative": ("a1", {"a0": f"""SELECT *, (isodow(date) - 1)::DOUBLE AS weekday_effect, (day(date) >= 28)::INT::DOUBLE AS month_end_effect,
            (open - {lag('close')}) / {lag('close')} AS overnight_gap,
            coalesce(abs(close - open) / nullif(high - low, 0) < 0.05, false)::INT AS doji FROM panel""",
                           "a1": "SELECT *, coalesce(abs(overnight_gap) > 0.005, false)::INT AS big FROM a0",
                           "a2": f"SELECT *, {r('avg', 'big', 21)} AS gap_frequency, {r('sum', 'doji', 5)} / 5.0::DOUBLE AS doji_signal FROM a1"}, "a2"),
}


def _family(name: str) -> None:
    cols = features.FAMILIES[name].columns
    base, extra, last = FAMILY_SQL[name]
    src = last or base
    body = "SELECT date, ticker, " + ", ".join(f"{lag(x)} AS {x}" for x in cols) + f" FROM {src}"

    @query(f"features_{name.lower()}", fin("date:d ticker:k " + " ".join(cols), body, extra))
    def _(t):
        return features.compute_families(t.panel(), context(t), [name])


for _name in features.FAMILIES:
    _family(_name)


@query("features_macro_with_vix", fin(
    "date:d ticker:k vix_regime macro_regime_score",
    f"SELECT date, ticker, {lag('v')} AS vix_regime, {lag('0.5 * a - 0.5 * v')} AS macro_regime_score FROM ("
    f"SELECT p.date, ticker, coalesce(v.close > 20, false)::INT::DOUBLE AS v, coalesce(p.close > a200, false)::INT::DOUBLE AS a FROM ("
    f"SELECT *, {r('avg', 'close', 200)} AS a200 FROM panel) p LEFT JOIN vix v ON p.date = v.date)"))
def _(t):
    panel = t.panel().join(t.vix().withColumnRenamed("close", "vix"), "date", "left")
    return features.compute_families(panel, context(t), ["Macro"]).select("date", "ticker", "vix_regime", "macro_regime_score")


def _joined(*names: str) -> str:
    """SQL of several checked queries over the same rows, side by side."""
    parts = [f"({ORACLES[n]}) q{i}" for i, n in enumerate(names)]
    return f"SELECT * FROM {parts[0]} " + " ".join(f"JOIN {p} USING (date, ticker)" for p in parts[1:])


@query("features_all_families", _joined(*(f"features_{f}" for f in (
    "momentum", "value", "quality", "growth", "liquidity", "volatility", "macro", "sentiment", "alternative"))))
def _(t):
    return features.compute_families(t.panel(), context(t))


# -- cross-section -------------------------------------------------------------------

_CLIP = {f: f"least(greatest({f}, quantile_cont({f}, 0.01) OVER (PARTITION BY date)), quantile_cont({f}, 0.99) OVER (PARTITION BY date))" for f in LIVE}
WINS = "SELECT date, ticker, " + ", ".join(f"CASE WHEN {f} IS NOT NULL THEN {x} END AS {f}" for f, x in _CLIP.items()) + " FROM core"
ZS = "SELECT date, ticker, " + ", ".join(
    f"({f} - avg({f}) OVER (PARTITION BY date)) / CASE WHEN stddev_samp({f}) OVER (PARTITION BY date) = 0 THEN 1e-6 "
    f"ELSE stddev_samp({f}) OVER (PARTITION BY date) END AS {f}" for f in LIVE)
NEU = "SELECT date, ticker, " + ", ".join(f"{f} - avg({f}) OVER (PARTITION BY date, coalesce(sector, 'Other')) AS {f}" for f in LIVE)
LIVE_SPEC = "date:d ticker:k " + " ".join(LIVE)


@query("xsection_winsorize", fin(LIVE_SPEC, WINS))
def _(t):
    return xsection.winsorize(t.core().select("date", "ticker", *LIVE), LIVE)


@query("xsection_zscore", fin(LIVE_SPEC, f"{ZS} FROM wins", {"wins": WINS}))
def _(t):
    return xsection.zscore(xsection.winsorize(t.core().select("date", "ticker", *LIVE), LIVE), LIVE)


@query("xsection_sector_neutral", fin(LIVE_SPEC, f"{NEU} FROM core LEFT JOIN smap USING (ticker)"))
def _(t):
    return xsection.neutralize(t.core().select("date", "ticker", *LIVE), LIVE, t.sector_map())


@query("xsection_percentile_rank", fin(LIVE_SPEC, "SELECT date, ticker, " + ", ".join(
    f"{pctrank(f, 'date', f in features.DESCENDING)} AS {f}" for f in LIVE) + " FROM core"))
def _(t):
    return xsection.rank_features(t.core().select("date", "ticker", *LIVE), LIVE)


_KEEP = " AND ".join(f"{f} IS NOT NULL" for f in LIVE)
_FIRST = ("return_1m", "return_5d", "volume_shock", "idiosyncratic_volatility")
_ROWS = " UNION ALL ".join(
    f"SELECT {i + 1} AS position, '{f}' AS feature, "
    + ("NULL::DOUBLE" if i == 0 else "(SELECT greatest(" + ", ".join(f"abs({corr(g, f)})" for g in LIVE[:i]) + ") FROM full_rows)")
    + f" AS max_earlier_corr, {str(f in _FIRST).lower()} AS protected" for i, f in enumerate(LIVE))


@query("xsection_correlation_pruning", fin(
    "position:i feature:k max_earlier_corr protected:k dropped:k",
    f"SELECT *, coalesce(max_earlier_corr > 0.6 AND NOT protected, false) AS dropped FROM ({_ROWS})",
    {"full_rows": f"SELECT * FROM core WHERE {_KEEP}"}))
def _(t):
    return xsection.correlation_table(t.core(), CORE)


_OWN = LIVE


@query("xsection_own_history_zscore", fin(
    LIVE_SPEC,
    "SELECT date, ticker, " + ", ".join(f"({f} - {r('avg', f, 252, 60)}) / ({r('stddev_samp', f, 252, 60)} + 1e-6) AS {f}" for f in _OWN)
    + " FROM (SELECT date, ticker, " + ", ".join(
        f"CASE WHEN {f} IS NOT NULL THEN least(greatest({f}, quantile_cont({f}, 0.01) OVER (PARTITION BY ticker)), quantile_cont({f}, 0.99) OVER (PARTITION BY ticker)) END AS {f}"
        for f in _OWN) + " FROM core)"))
def _(t):
    return xsection.own_history_zscore(core_rows(t).select("date", "ticker", *_OWN), _OWN, dealt=True)


@query("features_model_matrix")
def _(t):
    """The whole pre-model chain: winsorize, z-score, sector-neutralise, rank, prune."""
    from panelloom.functions import stage

    df = xsection.zscore(xsection.winsorize(t.core().select("date", "ticker", *LIVE), LIVE), LIVE)
    df = stage(xsection.rank_features(xsection.neutralize(df, LIVE, t.sector_map()), LIVE, like=t.core()), "matrix")
    return xsection.drop_correlated(df, LIVE)


# -- labels --------------------------------------------------------------------------

H = labels.HORIZONS
FWD = {h: f"({lead('close', h)} / nullif(close, 0) - 1)" for h in H}
FWDS = "SELECT date, ticker, close, ret, " + ", ".join(f"{FWD[h]} AS f{h}" for h in H) + " FROM rets"


@query("labels_forward_returns", fin("date:d ticker:k " + " ".join(f"fwd_ret_{h}d" for h in H),
                                     "SELECT date, ticker, " + ", ".join(f"{FWD[h]} AS fwd_ret_{h}d" for h in H) + " FROM rets"))
def _(t):
    return labels.forward_returns(t.panel())


@query("labels_target_rank", fin("date:d ticker:k close fwd target",
                                 f"SELECT *, {pctrank('fwd')} AS target FROM (SELECT date, ticker, close, {lead('close', 60)} / close - 1 AS fwd FROM panel)"))
def _(t):
    return labels.target_panel(t.panel())


_BENCH = "SELECT r.*, coalesce(mkt_ret, 0.0) AS b FROM rets r LEFT JOIN market USING (date)"


def _bench(h):
    o = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING)"
    return f"(CASE WHEN count(b) {o} = {h} THEN product(1 + b) {o} - 1 END)"


_REG = [f"{k}_fwd_{h}d" for h in H for k in ("ret", "log_ret", "excess_ret", "risk_adj_ret")]


@query("labels_regression", fin("date:d ticker:k " + " ".join(_REG), "SELECT date, ticker, " + ", ".join(
    f"{FWD[h]} AS ret_fwd_{h}d, ln({lead('close', h)} / close) AS log_ret_fwd_{h}d, {FWD[h]} - {_bench(h)} AS excess_ret_fwd_{h}d, "
    f"{FWD[h]} / nullif({r('stddev_samp', 'ret', 21)} * sqrt(252.0), 0) AS risk_adj_ret_fwd_{h}d" for h in H)
    + " FROM benched", {"benched": _BENCH}))
def _(t):
    df = labels.with_inputs(t.panel(), t.market())
    return labels.regression_labels(df, H, True)


def _class_sql(h):
    n = f"count(f{h}) OVER (PARTITION BY ticker)"
    q = lambda p: f"quantile_cont(f{h}, {p}) OVER (PARTITION BY ticker)"
    rn = f"row_number() OVER (PARTITION BY ticker ORDER BY f{h} NULLS LAST, date)"
    return (f"(f{h} > 0)::INT AS binary_fwd_{h}d, "
            f"CASE WHEN f{h} IS NOT NULL AND {n} > 10 THEN CASE WHEN f{h} >= {q(0.667)} THEN 2 WHEN f{h} <= {q(0.333)} THEN 0 ELSE 1 END END AS tertile_fwd_{h}d, "
            f"CASE WHEN f{h} IS NOT NULL AND {n} > 10 THEN greatest(0, ceil(({rn} - 1) * 5.0::DOUBLE / ({n} - 1)) - 1) END AS quintile_fwd_{h}d, "
            f"(f{h} - x{h} > 0)::INT AS excess_binary_fwd_{h}d")


_CLS = [f"{k}_fwd_{h}d" for h in H for k in ("binary", "tertile", "quintile", "excess_binary")]


@query("labels_classification", fin("date:d ticker:k " + " ".join(_CLS),
    "SELECT date, ticker, " + ", ".join(_class_sql(h) for h in H) + " FROM cl",
    {"benched": _BENCH, "cl": "SELECT date, ticker, " + ", ".join(f"{FWD[h]} AS f{h}, {_bench(h)} AS x{h}" for h in H) + " FROM benched"}))
def _(t):
    return labels.classification_labels(labels.with_inputs(t.panel(), t.market()), labels.LabelConfig(), True)


def _rank_sql(h):
    f, o = f"f{h}", "OVER (PARTITION BY date)"
    n = f"count({f}) {o}"
    rn = f"row_number() OVER (PARTITION BY date ORDER BY {f} NULLS LAST, ticker)"
    return (f"{pctrank(f)} AS rank_pct_fwd_{h}d, ({f} - avg({f}) {o}) / (stddev_samp({f}) {o} + 1e-8) AS rank_zscore_fwd_{h}d, "
            f"CASE WHEN {f} IS NOT NULL AND {n} > 1 THEN greatest(0, ceil(({rn} - 1) * 10.0::DOUBLE / nullif({n} - 1, 0)) - 1) + 1 END AS rank_decile_fwd_{h}d, "
            f"{f} / (stddev_samp({f}) {o} + 1e-8) AS rank_ir_fwd_{h}d")


_RNK = [f"{k}_fwd_{h}d" for h in H for k in ("rank_pct", "rank_zscore", "rank_decile", "rank_ir")]


@query("labels_ranking", fin("date:d ticker:k " + " ".join(_RNK),
                             "SELECT date, ticker, " + ", ".join(_rank_sql(h) for h in H) + " FROM fw", {"fw": FWDS}))
def _(t):
    return labels.ranking_labels(t.panel())


_DD = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING)"


@query("labels_custom_registry", fin(
    "date:d ticker:k custom_up custom_crash custom_mix custom_broken",
    f"SELECT date, ticker, up AS custom_up, crash AS custom_crash, coalesce(up, 0) * 0.7 + coalesce(crash, 0) * 0.3 AS custom_mix, NULL::DOUBLE AS custom_broken FROM ("
    f"SELECT date, ticker, ({lead('close', 21)} / close - 1 > 0.02)::INT AS up, CASE WHEN count(close) {_DD} = 21 THEN (min(close) {_DD} / close - 1 < -0.05)::INT END AS crash FROM panel)"))
def _(t):
    up, crash = labels.threshold_label(21, 0.02), labels.drawdown_label(21, -0.05)
    reg = labels.LabelRegistry().register("up", up).register("crash", crash)
    reg.register("mix", labels.composite_label([up, crash], [0.7, 0.3])).register("broken", lambda df: F.col("no_such_column"))
    return reg.compute(t.panel())


@query("labels_custom_pandas", fin(
    "date:d ticker:k custom_gap", f"SELECT date, ticker, {lead('close', 5)} - close AS custom_gap FROM panel"))
def _(t):
    reg = labels.LabelRegistry().register("gap", lambda pdf: pdf["close"].shift(-5) - pdf["close"], pandas=True)
    return reg.compute(t.panel())


@query("labels_all", _joined("labels_regression", "labels_classification", "labels_ranking"))
def _(t):
    return labels.label_panel(t.panel(), benchmark=t.market())


_HS = {"fw": FWDS, "hl": " UNION ALL ".join(f"SELECT ticker, {h} AS horizon_days, f{h} AS x FROM fw WHERE f{h} IS NOT NULL" for h in H),
       "hs": """SELECT ticker, horizon_days, count(*) AS valid_rows, avg(x) AS mean_return, stddev_samp(x) AS std_return,
            CASE WHEN count(*) > 2 THEN skewness(x) END AS skewness, avg((x > 0)::INT) AS pct_positive,
            CASE WHEN count(*) > 5 THEN avg(x) / nullif(stddev_samp(x), 0) * sqrt(252.0 / horizon_days) END AS sharpe_ratio FROM hl GROUP BY 1, 2"""}


@query("labels_horizon_summary", fin(
    "ticker:k horizon_days:i valid_rows:i mean_return std_return skewness pct_positive sharpe_ratio", "SELECT * FROM hs", _HS))
def _(t):
    return labels.horizon_summary(t.panel())


@query("labels_horizon_correlation", fin("horizon_a:i horizon_b:i corr", " UNION ALL ".join(
    f"SELECT {a} AS horizon_a, {b} AS horizon_b, covar_samp(f{a}, f{b}) / (stddev_samp(CASE WHEN f{b} IS NOT NULL THEN f{a} END) * stddev_samp(CASE WHEN f{a} IS NOT NULL THEN f{b} END)) AS corr FROM fw"
    for i, a in enumerate(H) for b in H[i + 1:]), {"fw": FWDS}))
def _(t):
    return labels.horizon_correlation(t.panel())


@query("labels_best_horizon", fin("ticker:k best_horizon:i", """
    SELECT ticker, coalesce(arg_max(horizon_days, (s, -horizon_days)) FILTER (s IS NOT NULL), 63) AS best_horizon
    FROM (SELECT *, floor(sharpe_ratio * 1e4 + 0.5) / 1e4 AS s FROM hs) GROUP BY ticker""", _HS))
def _(t):
    return labels.best_horizon(t.panel())
