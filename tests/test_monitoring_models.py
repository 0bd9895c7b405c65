import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.operators import insights, models, monitoring, tca
from panelloom.sources import io
from panelloom.streaming import streams
from tests.conftest import collect


@pytest.fixture(scope="module")
def alerts(spark):
    g = np.random.default_rng(11)
    t = np.cumsum(g.exponential(40, 800))
    t[400:] += 5000
    pdf = pd.DataFrame({"event_id": range(800), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(t, unit="s"),
                        "category": g.choice(["x", "y"], 800, p=[0.8, 0.2]), "metric": "m", "severity": g.choice(["INFO", "WARNING"], 800), "service": "s"})
    return spark.createDataFrame(pdf), pdf


def plain(pdf, cooldown, cap):
    last, fired, times = {}, [], []
    for r in pdf.sort_values(["ts", "event_id"]).itertuples():
        t, k = r.ts.timestamp(), (r.category, r.metric, r.severity)
        times = [x for x in times if t - x < 3600]
        if t - last.get(k, -1e18) >= cooldown and len(times) < cap:
            last[k] = t
            times.append(t)
            fired.append(r.event_id)
    return fired


def test_cooldown_and_cap_match_plain_pass(alerts):
    df, pdf = alerts
    assert sorted(r.event_id for r in monitoring.cooldown_filter(df).collect()) == plain(pdf, 300.0, 10**9)
    assert sorted(r.event_id for r in monitoring.throttle(df, hourly_cap=20).collect()) == plain(pdf, 300.0, 20)


def test_stream_equals_batch(spark, alerts, tmp_path):
    df, pdf = alerts
    for i in range(2):  # two files in time order: state carries over
        df.where((F.col("event_id") >= 400) if i else (F.col("event_id") < 400)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.run_to_table(streams.throttle_stream(src, hourly_cap=20, late="1 day"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r.event_id for r in out.collect()) == plain(pdf, 300.0, 20)


def test_drift_detects_shift(spark, both_slicings):
    g = np.random.default_rng(2)
    make = lambda m: spark.createDataFrame(pd.DataFrame({"a": g.normal(0, 1, 400), "b": g.normal(m, 1, 400)}))
    got = monitoring.feature_drift(make(0.0), make(1.5), ["a", "b"]).toPandas().set_index("feature")
    assert got.loc["a", "psi"] < 0.2 < got.loc["b", "psi"] and bool(got.loc["b", "drifted"])


def test_ks_statistic(spark, both_slicings):
    g = np.random.default_rng(4)
    a, b = np.round(g.normal(0, 1, 300), 1), np.round(g.normal(0.3, 1, 200), 1)
    one = lambda x: spark.createDataFrame(pd.DataFrame({"v": x}))
    got = monitoring.ks_test(monitoring.two_samples(one(a), one(b), ["v"])).first()
    grid = np.unique(np.r_[a, b])
    want = max(abs((a <= x).mean() - (b <= x).mean()) for x in grid)
    assert abs(got.ks_statistic - want) < 1e-12 and 0 <= got.ks_pvalue <= 1


def test_text_rules(spark):
    df = spark.createDataFrame([(1, "Record growth", "Strong demand and growth. We beat every single estimate! Tiny.", "X")],
                               "doc_id int, headline string, content string, symbol string")
    r = insights.news_sentiment(df).first()
    assert (r.n_positive, r.n_negative, r.sentiment_label, r.market_impact) == (5, 0, "POSITIVE", "HIGH BULLISH")
    keep = df.select(insights.takeaways(F.col("content"), F.col("headline")).alias("t")).first().t
    assert keep == ["Strong demand and growth", "We beat every single estimate"]


def test_recommendation_default(spark):
    row = [(1, 1.0, -0.1, 10.0, 1.0, "LOW", False, True), (2, 0.1, -0.3, 10.0, 9.0, "HIGH", True, False)]
    df = spark.createDataFrame(row, "id int, sharpe_ratio double, max_drawdown double, ann_fixed_cost_bp double, ann_turnover double, "
                                    "risk_grade string, drift_detected boolean, quality_passed boolean")
    got = insights.recommendations(df, ["id"]).toPandas()
    assert got[got.id == 1]["domain"].tolist() == ["MAINTENANCE"] and len(got[got.id == 2]) == 6
    why = got[got.id == 2].set_index("domain")["rationale"]
    assert why["MODEL_TUNING"] == "Backtest Sharpe ratio (0.10) is below target threshold 0.80."
    assert why["RISK_CONTROL"] == "Max drawdown (-30.0%) exceeds risk threshold of -20%."
    assert why["EXECUTION_COSTS"] == "Annualised turnover (9.0x) generates 10 bps in transaction costs."


def test_explanation_tells_what_is_known(spark):
    pred = spark.createDataFrame([(1, "AAA", 0.031, 0.625, 0.01, 0.05), (2, "BBB", -0.3, None, None, None)], "id int, ticker string, score double, probability double, lower double, upper double")
    att = spark.createDataFrame([(1, "x", 0.2), (1, "y", -0.5), (1, "z", None)], "id int, feature string, value double")
    a, b = insights.explain_predictions(pred, att, ["id"]).orderBy("id").collect()
    assert a.narrative == "The model maintains a BULLISH stance (Moderate Outperform) on AAA with an expected return of +3.10% with 62.5% probability [95% CI: 0.010 to 0.050]."
    assert [(d.feature, d.value, d.impact) for d in a.drivers] == [("y", -0.5, "negative"), ("x", 0.2, "positive")] and a.key_drivers == "y,x"
    assert b.narrative == "The model maintains a BEARISH stance (Strong Underperform) on BBB with an expected return of -30.00%." and b.drivers is None


def test_contributions_in_columns_are_ranked_in_place(spark):
    feats = ["b", "a", "c"]
    rows = [(1, "x", 0.5, -0.5, 0.1), (2, "x", None, 2.0, -3.0), (3, "x", None, None, None), (4, None, 1.0, 0.0, -0.0), (5, "x", float("nan"), 9.0, -9.0)]
    wide = spark.createDataFrame(rows, "id int, name string, b double, a double, c double")
    long, keys = wide.unpivot(["id", "name"], feats, "feature", "value"), ["id", "name"]
    rows = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    plan = insights._drivers(wide, keys, 2, feats)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan
    pred = wide.select("id", "name", (F.col("id") / 50.0 - 0.05).alias("score"), F.lit("T").alias("ticker"))
    assert rows(insights.explain_predictions(pred, wide, keys, 2, feats)) == rows(insights.explain_predictions(pred, long, keys, 2))
    assert rows(insights.attribution_split(wide, keys, 0.5, 2, feats)) == rows(insights.attribution_split(long, keys, 0.5, 2))


def test_fold_table_and_conformal(spark, panel):
    folds = collect(models.cv_folds(panel, min_train=10, min_test=10), "fold")
    assert len(folds) == 5 and (folds["train_end"] < folds["test_start"]).all()
    g = np.random.default_rng(0)
    make = lambda n: spark.createDataFrame(pd.DataFrame({"prediction": np.zeros(n), "target": g.normal(0, 1, n)}))
    got = models.conformal(make(500), make(500)).toPandas()
    cover = ((got["target"] >= got["lower"]) & (got["target"] <= got["upper"])).mean()
    assert 0.85 <= cover <= 0.95


def test_ensemble_learns_a_signal(spark):
    g = np.random.default_rng(8)
    n = 1500
    x = g.normal(size=n)
    pdf = pd.DataFrame({"date": np.repeat(pd.bdate_range("2020-01-01", periods=50).date, 30), "ticker": np.tile([f"t{i}" for i in range(30)], 50),
                        "f0": x, "f1": g.normal(size=n), "target": x + 0.3 * g.normal(size=n)})
    df = spark.createDataFrame(pdf)
    e = models.fit_ensemble(df, ["f0", "f1"], n_models=1, p=models.Params(depth=3, rounds=4, rate=0.3), guard=False)
    assert e.report[0]["val_ic"] > 0.5
    top = models.importance_summary(models.importance_table(e, spark)).orderBy("rank").first()
    assert top.feature == "f0"


def test_orders_and_slices(spark):
    candles = spark.createDataFrame([(dt.date(2024, 1, d), "A", 10.0, 11.0, 9.0, 10.0, 1000.0 * d) for d in (1, 2, 3)],
                                    "date date, ticker string, open double, high double, low double, close double, volume double")
    orders = spark.createDataFrame([(1, dt.date(2024, 1, 3), "A", "BUY", 600.0, 9.5), (2, dt.date(2024, 1, 4), "A", "SELL", 100.0, 12.0)],
                                   "order_id int, date date, ticker string, side string, qty double, limit_price double")
    m = tca.with_candle(orders, candles)
    fills = tca.market_fills(m).toPandas().set_index("order_id")
    assert fills.loc[1, "fill_qty"] == 300.0 and fills.loc[1, "fill_price"] > 10 > fills.loc[2, "fill_price"]
    assert [r.order_id for r in tca.limit_fills(m).collect()] == [1]
    w = tca.vwap_slices(orders, candles, 3).where("order_id = 1").toPandas().sort_values("slice")
    np.testing.assert_allclose(w["qty"], [100, 200, 300])
    u = tca.vwap_slices(orders, candles, 5).where("order_id = 1").toPandas().sort_values("slice")["qty"].tolist()
    assert abs(sum(u) - 600) < 1e-9 and u[0] > u[2]
    rolled = tca.report(tca.roll_up(tca.market_fills(m), m.select("order_id", "side", "qty", F.col("close").alias("arrival_price")))).toPandas().set_index("order_id")
    assert rolled.loc[1, "status"] == "PARTIALLY_FILLED" and rolled.loc[1, "fill_rate_pct"] == 50 and (rolled["shortfall_bps"] > 0).all()


def test_versions(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.col("id") * 1.5)
    one = io.create_version(df, "d", str(tmp_path), "a", "b")
    assert io.load_version(spark, str(tmp_path), one).count() == 10
    assert io.fingerprint(df).first() == io.fingerprint(df.orderBy(F.desc("id"))).first()
    with pytest.raises(ValueError):
        io.create_version(df.limit(0), "d", str(tmp_path), "a", "b")
    with pytest.raises(FileNotFoundError):
        io.load_version(spark, str(tmp_path), "none")
