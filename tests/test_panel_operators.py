import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.functions import Frames, order_stats
from panelloom.operators import features, labels, quality, universe, xsection
from tests.conftest import collect


def test_features_are_lagged_and_in_range(panel):
    got = collect(features.compute_families(panel), "ticker", "date")
    cols = [x for f in features.FAMILIES.values() for x in f.columns]
    assert len(features.FAMILIES) == 9 and set(cols) <= set(got.columns)
    first = got.groupby("ticker").head(1)
    assert first[cols].isna().all().all()
    rsi = got["rsi_14"].dropna()
    assert len(rsi) and rsi.between(0, 100).all()
    assert (got["amihud_illiquidity"].dropna() >= 0).all()


def test_core_momentum_matches_pandas(panel, panel_pd):
    got = collect(features.core_features(panel), "ticker", "date")
    p = panel_pd.sort_values(["ticker", "date"])
    want = p.groupby("ticker")["close"].transform(lambda s: (s / s.shift(21) - 1).shift(1))
    np.testing.assert_allclose(got["return_1m"], want.to_numpy(), atol=1e-12)
    np.testing.assert_allclose(got["residual_momentum"], want.to_numpy(), atol=1e-12)


def test_single_core_features_equal_the_whole_set(panel):
    market = panel.groupBy("date").agg(F.avg(F.col("close") / F.col("open") - 1.0).alias("ctx_ret"))
    for context in (market, None):
        whole = collect(features.core_features(panel, context), "ticker", "date")
        for some in (["bollinger_distance"], ["residual_momentum", "volume_shock"], ["idiosyncratic_volatility"], ["amihud_illiquidity", "volatility_regime", "roe"]):
            got = collect(features.core_features(panel, context, some), "ticker", "date")
            pd.testing.assert_frame_equal(got, whole[got.columns], check_exact=True)
            assert set(got.columns) == {"date", "ticker", "close", *some}


def test_zscore_joins_moments_without_moving_rows(spark, panel):
    df = panel.select("date", "ticker", "close", "volume")
    z = xsection.zscore(df, ["close", "volume"])
    plan = z._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    p = df.toPandas()
    by = p.groupby("date")["close"]
    want = ((p["close"] - by.transform("mean")) / by.transform("std")).sort_values().to_numpy()
    np.testing.assert_allclose(np.sort(z.toPandas()["close"].to_numpy()), want, atol=1e-12)


def test_cross_section_does_not_depend_on_slices(spark, panel, monkeypatch):
    feats = ["return_5d", "volume_shock"]
    df = features.core_features(panel).select("date", "ticker", *feats).cache()

    def run():
        z = xsection.rank_features(xsection.winsorize(df, feats), feats)
        return collect(z, "ticker", "date")[["ticker", "date", *feats]], collect(labels.ranking_labels(panel, (5,)), "ticker", "date")

    usual, cut = run(), order_stats._sliced
    monkeypatch.setattr(order_stats, "_sliced", lambda d, keys, value, _: cut(d, keys, value, 2))
    for a, b in zip(usual, run()):
        pd.testing.assert_frame_equal(a, b[a.columns], check_exact=False, atol=1e-9)


def odd_columns(spark):
    g = np.random.default_rng(3)
    pdf = pd.DataFrame({"d": np.repeat(["a", "b", "c"], 60), "id": np.arange(180), "x": g.integers(0, 6, 180) * 1.0, "y": g.normal(size=180)})
    pdf.loc[:35, "x"], pdf.loc[g.choice(180, 40, False), "y"] = 2.0, np.nan
    pdf.loc[pdf["d"] == "c", "x"] = np.nan
    return pdf, spark.createDataFrame(pdf).withColumns({v: F.nanvl(v, F.lit(None)) for v in "xy"})


@pytest.mark.parametrize("group_rows", [1000, 5], ids=["whole-groups", "slices"])
def test_ranks_and_quantiles_of_many_columns(spark, group_rows):
    pdf, df = odd_columns(spark)
    bound = {"group_rows": group_rows, "slice_rows": 7}
    got = collect(order_stats.rank_columns(df, ["d"], ["x", "y"], ["y"], tie="id", **bound), "id")
    by = pdf.groupby("d")
    np.testing.assert_allclose(got["x"], by["x"].rank(pct=True))
    np.testing.assert_allclose(got["y"], by["y"].rank(pct=True, ascending=False))
    np.testing.assert_allclose(got["__place_x"].astype(float), by["x"].rank(method="first"))
    centred = collect(order_stats.rank_columns(df, ["d"], ["x", "y"], centred=True, **bound), "id")
    np.testing.assert_allclose(centred["y"], by["y"].rank() - (by["y"].transform("count") + 1) / 2)
    cuts = collect(order_stats.column_quantiles(df, ["d"], ["x", "y"], {"lo": 0.07, "hi": 0.9}, **bound), "d").set_index("d")
    for name, q in (("lo", 0.07), ("hi", 0.9)):
        for v in "xy":
            np.testing.assert_allclose(cuts[f"{name}_{v}"].astype(float), by[v].quantile(q))


def test_rows_without_a_date_stay_unranked(spark):
    rows = [("d", "A", 1.0, 2.0), ("d", "B", 3.0, None), (None, "C", 5.0, None), (None, "D", 5.0, 6.0)]
    df = spark.createDataFrame(rows, "date string, ticker string, x double, y double")
    got = {r.ticker: (r.x, r.y) for r in order_stats.rank_columns(df, ["date"], ["x", "y"]).collect()}
    assert got == {"A": (0.5, 1.0), "B": (1.0, None), "C": (None, None)}


def test_a_chain_of_sliced_ranks_stays_small(spark):
    _, df = odd_columns(spark)
    plan = order_stats.rank_columns(df.withColumns({f"z{i}": F.col("y") * i for i in range(8)}), ["d"], [f"z{i}" for i in range(8)], group_rows=5, slice_rows=7)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Window") < 60


def test_label_panel_is_its_parts_side_by_side(panel):
    bench = panel.select("date").distinct().withColumn("mkt_ret", F.dayofmonth("date") / 1000.0)
    got = collect(labels.label_panel(panel, benchmark=bench), "ticker", "date")
    df = labels.with_inputs(panel, bench)
    parts = [labels.regression_labels(df, labels.HORIZONS, True), labels.classification_labels(df, labels.LabelConfig(), True), labels.ranking_labels(panel)]
    want = pd.concat([collect(x, "ticker", "date").set_index(["ticker", "date"]) for x in parts], axis=1).reset_index()
    pd.testing.assert_frame_equal(got[want.columns], want, check_exact=False, atol=1e-12)


def test_rank_labels_need_a_forward_return(spark, panel):
    got = collect(labels.ranking_labels(panel, (5,)), "ticker", "date")
    last = got.groupby("ticker").tail(5)
    assert last.filter(like="rank_").isna().all().all() and got["rank_decile_fwd_5d"].notna().sum() == len(got) - len(last)


def test_rows_without_a_date_count_in_own_history_but_have_no_label_row(panel):
    odd = panel.withColumn("date", F.when(F.dayofmonth("date") != 11, F.col("date")))
    got = collect(labels.label_panel(odd), "ticker", "date")
    assert got["date"].notna().all() and len(got) == odd.where("date is not null").count()
    own = collect(labels.classification_labels(labels.with_inputs(odd, None), labels.LabelConfig(), False).where("date is not null"), "ticker", "date")
    pd.testing.assert_frame_equal(got[own.columns], own)


def test_ranks_keep_repeated_rows_and_missing_values(spark):
    rows = [("2024-01-02", "A", 1.0), ("2024-01-02", "A", 3.0), ("2024-01-02", "B", 2.0), ("2024-01-02", "C", None), ("2024-01-02", "D", 2.0)]
    df = spark.createDataFrame(rows, "date string, ticker string, volume_shock double")
    got = sorted((r.ticker, r.volume_shock) for r in xsection.rank_features(df, ["volume_shock"], []).collect() if r.ticker != "C")
    assert got == [("A", 0.25), ("A", 1.0), ("B", 0.625), ("D", 0.625)]
    assert xsection.rank_features(df, ["volume_shock"], []).count() == 5


@pytest.mark.parametrize("odd", ["nan", "inf", "level"])
def test_rolling_columns_heed_only_their_frame(spark, odd):
    g = np.random.default_rng(5)
    x = 100 + g.normal(size=400).cumsum()
    if odd == "level":
        x[:200], x[200:] = 20_000.0, 1.0 + 0.005 * g.normal(size=200)
    else:
        x[50] = float(odd)
    pdf = pd.DataFrame({"ticker": "A", "date": pd.bdate_range("2020-01-01", periods=400).date, "x": x, "y": g.normal(size=400)})
    frames, fn = Frames(), {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "max": F.max}
    cols = {k: frames.roll(f, "x", 20, 5) for k, f in fn.items()} | {"corr": frames.corr("y", "x", 30)}
    got = collect(frames.add(spark.createDataFrame(pdf), cols), "date")
    clean = pdf["x"].where(np.isfinite(pdf["x"]))
    for k in fn:  # each window on its own: rolling().std() carries rounding on from window to window
        want = clean.rolling(20, min_periods=5).apply(lambda v, k=k: getattr(pd.Series(v).dropna(), k)(), raw=True)
        np.testing.assert_allclose(got[k].astype(float), want, rtol=1e-6, atol=1e-9)
    if odd != "level":
        np.testing.assert_allclose(got["corr"].astype(float), clean.rolling(30).corr(pdf["y"]), rtol=1e-6, atol=1e-9)


def test_correlated_feature_is_pruned(spark):
    g = np.random.default_rng(0)
    x = g.normal(size=600)
    pdf = pd.DataFrame({"return_1m": x, "return_3m": x + 0.01 * g.normal(size=600), "volume_shock": g.normal(size=600)})
    out = xsection.drop_correlated(spark.createDataFrame(pdf), list(pdf.columns))
    assert out.columns == ["return_1m", "volume_shock"]


def test_labels_end_null_and_buckets_match_qcut(panel, panel_pd):
    got = collect(labels.label_panel(panel, labels.LabelConfig(horizons=(5,))), "ticker", "date")
    assert got.groupby("ticker").tail(5)["ret_fwd_5d"].isna().all()
    assert set(got["binary_fwd_5d"].dropna()) <= {0.0, 1.0}
    assert got["rank_pct_fwd_5d"].dropna().between(0, 1).all()
    for _, d in got.groupby("ticker"):
        f = d["ret_fwd_5d"].dropna()
        want = pd.qcut(f.rank(method="first"), 5, labels=False)
        assert (d.loc[f.index, "quintile_fwd_5d"] == want).all()


def test_label_registry(panel):
    reg = labels.LabelRegistry().register("up", labels.threshold_label(5, 0.0)).register("bad", lambda df: F.col("nope"))
    reg.register("py", lambda pdf: pdf["close"].shift(-1), pandas=True)
    with pytest.warns(UserWarning, match="label bad is null"):
        made = reg.compute(panel)
    got = collect(made, "ticker", "date")
    audit = quality.column_audit(made, quality.label_rules([], custom=reg.list_labels())).where("check = 'null_share'").collect()
    assert {r.column: r.passed for r in audit} == {"custom_up": True, "custom_bad": False, "custom_py": True}
    assert reg.list_labels() == ["up", "bad", "py"]
    assert got["custom_bad"].isna().all() and got["custom_py"].notna().sum() == len(got) - 4
    assert reg.unregister("bad").list_labels() == ["up", "py"]
    with pytest.raises(ValueError):
        labels.composite_label([labels.threshold_label()], [0.5, 0.5])


def test_cleaning_counts(spark):
    rows = [("2024-01-01", "A", 1, 10.0), ("2024-01-01", "A", 2, 11.0), ("2024-01-02", "A", 3, None), ("2024-01-03", "A", 4, 10.5)]
    df = spark.createDataFrame(rows, "d string, ticker string, ingest_seq int, close double").select(
        F.to_date("d").alias("date"), "ticker", "ingest_seq", *[F.col("close").alias(x) for x in ("open", "high", "low", "close")])
    clean = quality.validate_panel(df, max_fail=0.9)
    assert clean.count() == 2 and clean.agg(F.min("close")).first()[0] == 10.0
    with pytest.raises(ValueError):
        quality.validate_panel(df, max_fail=0.01)


def test_spike_and_stale_rules(spark):
    closes = [100, 101, 102, 500, 103, 104, 104, 104, 104, 104, 104]
    rows = [(f"2024-01-{i + 1:02d}", i, float(v)) for i, v in enumerate(closes)]
    df = spark.createDataFrame(rows, "d string, ingest_seq int, close double").select(
        F.to_date("d").alias("date"), F.lit("A").alias("ticker"), "ingest_seq", *[F.col("close").alias(x) for x in ("open", "high", "low", "close")])
    got = collect(quality.flag_steps(df), "date")["drop_reason"].tolist()
    # the row after a spike goes too; the fifth and later equal closes are stale
    assert got == [None, None, None, "jump", "jump", None, None, None, None, "stale", "stale"]


def test_point_in_time_universe(spark, panel):
    entries = spark.createDataFrame([("AAA", "2022-01-01"), ("BBB", "2022-07-01")], "ticker string, e string").select(
        "ticker", F.to_date("e").alias("entry_date"))
    snaps = universe.membership_grid(entries, "2022-01-01", "2022-07-01")
    got = collect(universe.members_at(panel, snaps).groupBy("ticker").agg(F.min("date").alias("first")), "ticker")
    assert got["ticker"].tolist() == ["AAA", "BBB"]
    assert str(got["first"][1]) == "2022-07-01"


def test_traded_value_of_some_names_is_theirs_in_the_whole_panel(spark, panel):
    names = spark.createDataFrame([("BBB",), ("BBB",), ("DDD",), (None,), ("none",)], "ticker string")
    whole = universe.traded_value(panel).where(F.col("ticker").isin("BBB", "DDD"))
    some = universe.traded_value(panel, names=names)
    pd.testing.assert_frame_equal(collect(some, "ticker", "date"), collect(whole, "ticker", "date"))


def test_own_history_is_clipped_without_a_window_of_percentiles(spark):
    g = np.random.default_rng(3)
    rows = pd.DataFrame({"date": np.tile(pd.bdate_range("2020-01-01", periods=90).date, 3), "ticker": np.repeat(["A", "B", None], 90), "x": g.standard_t(2, 270)})
    rows.loc[::7, "x"] = None
    rows["y"] = np.nan
    df = spark.createDataFrame(rows.astype(object).where(rows.notna(), None).values.tolist(), "date date, ticker string, x double, y double")
    got = xsection.own_history_zscore(df, ["x", "y"])
    assert "percentile" not in got._jdf.queryExecution().toString()
    got = collect(got.withColumn("ticker", F.coalesce("ticker", F.lit("~"))), "ticker", "date")
    rows["ticker"] = rows["ticker"].fillna("~")
    rows = rows.sort_values(["ticker", "date"]).reset_index(drop=True)
    by = lambda x: x.groupby(rows["ticker"])
    cut = rows["x"].clip(by(rows["x"]).transform(lambda s: s.quantile(0.01)), by(rows["x"]).transform(lambda s: s.quantile(0.99)))
    roll = by(cut).rolling(252, min_periods=60)
    want = (cut - roll.mean().reset_index(drop=True)) / (roll.std().reset_index(drop=True) + 1e-6)
    np.testing.assert_allclose(got["x"].astype(float), want, atol=1e-9)
    assert want.notna().any() and got["y"].isna().all()
