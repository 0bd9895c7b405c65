import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.functions import calendar, pct_change, by_ticker
from panelloom.operators import alpha, backtest, portfolio, risk, solvers
from tests.conftest import collect


@pytest.fixture(scope="module")
def setup(spark, panel, panel_pd):
    g = np.random.default_rng(3)
    dates = sorted(panel_pd["date"].unique())
    rows = [(d, t, float(g.random())) for d in dates[5::21] for t in ("AAA", "BBB", "CCC", "DDD")]
    scores = spark.createDataFrame(rows, "date date, ticker string, score double")
    weights = portfolio.top_k_schedule(scores, [2, 3]).cache()
    returns = panel.select("date", "ticker", pct_change("close", by_ticker()).alias("ret")).where("ret is not null").cache()
    return scores, weights, returns, calendar(panel)


def wide(panel_pd):
    return panel_pd.pivot(index="date", columns="ticker", values="close").pct_change().fillna(0.0)


def test_backtest_matches_dense_pandas(setup, panel_pd):
    _, weights, returns, cal = setup
    cfg = backtest.Config(capital=1e5)
    got = collect(backtest.run(weights, returns, cal, cfg=cfg).where("portfolio_id = 2"), "date")
    r = wide(panel_pd)
    w = weights.where("portfolio_id = 2").toPandas().pivot(index="rebal_date", columns="ticker", values="weight").fillna(0.0)
    held = w.reindex(r.index).ffill().fillna(0.0).reindex(columns=r.columns, fill_value=0.0).shift(1).fillna(0.0)
    gross = (held * r).sum(axis=1)
    scale = (0.18 / (gross.rolling(60, min_periods=20).std() * np.sqrt(252))).clip(0.2, 1.0).fillna(1.0)
    held = held.mul(scale, axis=0)
    net = (held * r).sum(axis=1) - held.diff().abs().sum(axis=1) * 0.0015
    np.testing.assert_allclose(got["net"], net, atol=1e-10)
    np.testing.assert_allclose(got["equity"], 1e5 * (1 + net).cumprod(), rtol=1e-9)
    assert got["gross"].iloc[0] == 0 and (got["drawdown"] <= 1e-12).all() and (got["net"] <= got["gross"] + 1e-15).all()


def test_hysteresis_matches_plain_walk(spark):
    g = np.random.default_rng(5)
    dates = pd.date_range("2020-01-01", periods=12, freq="MS").date
    rows = [(d, f"t{i:02d}", float(g.random())) for d in dates for i in range(30) if g.random() > 0.1]
    scores = spark.createDataFrame(rows, "date date, ticker string, score double")
    top, buffer, hold, emergency = 6, 8, 50, 12
    got = portfolio.hysteresis_schedule(scores, {1: top}, min_hold=hold, emergency_rank=emergency).toPandas()
    held = {}
    for d in dates:
        day = sorted([(-s, t) for x, t, s in rows if x == d])
        rank = {t: i + 1 for i, (_, t) in enumerate(day)}
        sold = {t for t, a in held.items() if t not in rank or (rank[t] > buffer and (a >= hold or rank[t] > emergency))}
        stay = {t: a for t, a in held.items() if t not in sold}
        new = [t for _, t in day if rank[t] <= top and t not in stay][: max(0, top - len(stay))]
        held = {t: a + 21 for t, a in {**stay, **{t: 0 for t in new}}.items()}
        rows_got = got[got["rebal_date"] == d]
        assert dict(zip(rows_got["ticker"], rows_got["days_held"])) == held


def test_solvers(spark, setup, panel):
    scores, weights, returns, _ = setup
    cov = solvers.covariance(weights, returns, panel, window=100).cache()
    for name in portfolio.list_strategies():
        w = portfolio.optimize(name, weights, cov=cov, scores=scores).toPandas()
        total = w.groupby(["portfolio_id", "rebal_date"])["weight"].sum()
        np.testing.assert_allclose(total, 1.0, atol=1e-9)
        assert (w["weight"] >= -1e-12).all()
    with pytest.raises(KeyError):
        portfolio.optimize("no_such", weights)


def test_risk_parity_shares_are_equal():
    g = np.random.default_rng(4)
    for n in (1, 2, 7, 40):
        a = g.normal(size=(n, 2 * n)) * np.geomspace(0.1, 5, n)[:, None] + g.normal(size=(1, 2 * n))
        cov = a @ a.T / (2 * n)
        w = solvers._risk_parity(cov, None)
        share = w * (cov @ w) / (w @ cov @ w)
        assert (w > 0).all() and np.allclose(share, 1 / n, atol=1e-9)
    assert np.isfinite(solvers._risk_parity(np.zeros((3, 3)), None)).all()


def test_normal_draws_do_not_depend_on_partitions(spark):
    rows = spark.range(20_000).select(F.lit(7).alias("seed"), "id")
    draw = lambda df: {r.id: r.x for r in df.select("id", risk.normal_draws(F.col("seed"), F.col("id")).alias("x")).collect()}
    one, other = draw(rows.coalesce(1)), draw(rows.repartition(13))
    assert one == other
    x = np.array(list(one.values()))
    assert abs(x.mean()) < 0.03 and abs(x.std() - 1) < 0.03 and abs(np.mean(x**4) - 3) < 0.25


def test_min_variance_respects_cap():
    g = np.random.default_rng(0)
    a = g.normal(size=(8, 40))
    cov = np.cov(a) * np.linspace(1, 9, 8)
    cov = (cov + cov.T) / 2 + np.eye(8)
    w = solvers._min_variance(cov, None)
    assert abs(w.sum() - 1) < 1e-8 and w.max() <= 0.2 + 1e-9
    for _ in range(200):  # no feasible neighbour is better
        d = g.normal(size=8)
        v = solvers._capped_simplex(w + 1e-3 * d, 0.2)
        assert v @ cov @ v >= w @ cov @ w - 1e-9


def test_hrp_orders_by_cluster():
    dist = np.array([[0, 0.1, 0.9, 0.8], [0.1, 0, 0.7, 0.9], [0.9, 0.7, 0, 0.2], [0.8, 0.9, 0.2, 0]])
    assert solvers._leaf_order(dist) == [0, 1, 2, 3]


def test_kelly_without_scores_uses_mean_returns(spark, panel, panel_pd):
    from panelloom.functions import by_ticker, pct_change

    day = sorted(panel_pd["date"])[-1]
    held = spark.createDataFrame([(1, day, t) for t in ("AAA", "BBB", "CCC")], "portfolio_id int, rebal_date date, ticker string")
    rets = panel.select("date", "ticker", pct_change("close", by_ticker()).alias("ret")).where("ret is not null")
    cov, means = solvers.covariance(held, rets, panel), solvers.mean_returns(held, rets, panel)
    got = solvers.kelly(held, cov, means=means).toPandas().set_index("ticker")["weight"]
    m = cov.toPandas().pivot(index="i", columns="j", values="cov").sort_index()
    mu = means.toPandas().set_index("ticker")["mean"].sort_index()
    want = np.maximum(0, np.linalg.pinv(m.to_numpy()) @ mu.to_numpy())
    want = want / want.sum() if want.sum() > 0 else np.full(3, 1 / 3)
    np.testing.assert_allclose(got.sort_index(), want, atol=1e-9)


def test_sequential_no_trade_zone(spark):
    rows = [(1, "2020-01-01", "a", 0.5), (1, "2020-01-01", "b", 0.5), (1, "2020-02-01", "a", 0.502), (1, "2020-02-01", "c", 0.498)]
    w = spark.createDataFrame(rows, "portfolio_id int, d string, ticker string, weight double").select(
        "portfolio_id", F.to_date("d").alias("rebal_date"), "ticker", "weight")
    got = portfolio.no_trade_schedule(w, 0.005).where("rebal_date = '2020-02-01'").toPandas().set_index("ticker")["weight"]
    want = pd.Series({"a": 0.5, "b": 0.0, "c": 0.498}) / 0.998
    np.testing.assert_allclose(got[want.index], want)


def test_clip_normalize(spark):
    rows = [(1, t, v) for t, v in zip("abcde", [0.6, 0.2, 0.1, 0.06, 0.04])]
    w = spark.createDataFrame(rows, "portfolio_id int, ticker string, weight double").withColumn("rebal_date", F.to_date(F.lit("2020-01-01")))
    got = portfolio.clip_normalize(w, 0.0, 0.3).toPandas()
    assert abs(got["weight"].sum() - 1) < 1e-5 and got["weight"].max() <= 0.3 + 1e-9


def test_ic_and_spread(setup, panel, both_slicings):
    scores, _, returns, _ = setup
    ic = alpha.daily_ic(scores, panel, [5], min_names=3).toPandas()
    assert len(ic) and ic["ic"].between(-1, 1).all()
    spread = alpha.decile_spread(scores, panel, returns, min_names=2).toPandas()
    first = spread[spread["start"] == spread["start"].min()].sort_values("date")
    assert first["cost"].iloc[-1] > 0 and (first["cost"].iloc[:-1] == 0).all()


def test_average_correlation_equals_pairwise(setup, panel, panel_pd):
    _, _, returns, _ = setup
    got = risk.average_correlation(returns, panel).first()
    m = wide(panel_pd).corr().to_numpy()
    assert got.n_names == 4 and abs(got.avg_pairwise_correlation - m[np.triu_indices(4, 1)].mean()) < 1e-9


def test_tail_index_recovers_shape(spark):
    g = np.random.default_rng(7)
    xi = 0.3
    x = ((1 - g.random(40_000)) ** -xi - 1) / xi
    df = spark.createDataFrame(pd.DataFrame({"portfolio_id": 1, "net": -0.01 * x})).withColumn("portfolio_id", F.col("portfolio_id").cast("int"))
    got = risk.tail_index(df).first()
    assert got.n_exceedances == 2000 and abs(got.tail_index - xi) < 0.08


def test_cvar_not_below_var_and_effective_names(setup, panel):
    _, weights, returns, cal = setup
    daily = backtest.run(weights, returns, cal, cfg=backtest.Config(capital=1e5)).cache()
    v = risk.historical_var(daily).toPandas()
    assert (v["cvar_95"] >= v["var_95"] - 1e-12).all()
    c = risk.concentration(weights).toPandas()
    np.testing.assert_allclose(c["effective_n"], c["portfolio_id"])


def test_row_shift_reads_later_rows_without_a_second_join(panel, panel_pd):
    scores = panel.select("date", "ticker", F.col("volume").alias("score")).where("day(date) % 2 = 0")
    got = alpha.forward_pairs(scores, panel.withColumn("close", F.when(F.col("close") > 95, F.col("close"))), [1, 21], calendar_shift=False)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    p = panel_pd[panel_pd["close"] > 95].sort_values(["ticker", "date"])
    want = pd.concat([p.assign(horizon=h, fwd=p.groupby("ticker")["close"].shift(-h) / p["close"] - 1) for h in (1, 21)])
    want = want[want["fwd"].notna() & pd.to_datetime(want["date"]).dt.day.mod(2).eq(0)].sort_values(["horizon", "ticker", "date"])
    got = collect(got, "horizon", "ticker", "date")
    assert len(got) == len(want) and list(got["ticker"]) == list(want["ticker"])
    np.testing.assert_allclose(got["fwd"], want["fwd"])


def test_only_held_names_are_rolled_over_for_traded_value_and_beta(spark):
    from panelloom.plans import q_risk

    class Given:
        def __init__(self, spark):
            days = pd.bdate_range("2020-01-01", periods=30).date
            self.rows = spark.createDataFrame(pd.DataFrame({
                "date": np.tile(days, 3), "ticker": np.repeat(["A", "B", "C"], 30), "close": 10.0, "volume": 5.0, "ret": np.random.default_rng(1).normal(size=90)}))

        def panel(self):
            return self.rows.select("date", "ticker", "close", "volume")

        def close_returns(self):
            return self.rows.select("date", "ticker", "ret")

        def market(self):
            return self.rows.groupBy("date").agg(F.avg("ret").alias("mkt_ret"))

        def weights(self):
            return self.rows.where("ticker = 'B'").select(F.lit(1).alias("portfolio_id"), F.col("date").alias("rebal_date"), "ticker", F.lit(1.0).alias("weight"))

    t = Given(spark)
    for table in (q_risk.adv_at(t), q_risk.betas(t)):
        assert [r.ticker for r in table.select("ticker").distinct().collect()] == ["B"]
