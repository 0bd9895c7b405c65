import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelloom.functions import columns
from panelloom.functions import Frames, asof_join, average_rank, ordered_counts, percent_rank, quantiles, row_positions, stage, tidy
from tests.conftest import collect


def sample(spark, seed=0):
    g = np.random.default_rng(seed)
    pdf = pd.DataFrame({"k": np.where(g.random(600) < 0.6, "hot", g.choice(list("abc"), 600)), "id": [f"{i:04d}" for i in range(600)],
                        "v": np.round(g.normal(0, 1, 600), 1)})
    pdf.loc[g.random(600) < 0.1, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None)))
    return pdf, df


def test_ranks_match_pandas(spark, both_slicings):
    pdf, df = sample(spark)
    got = collect(percent_rank(average_rank(df, ["k"], "v", "r"), ["k"], "v", "p", descending=True), "id")
    want = pdf.sort_values("id").reset_index(drop=True)
    np.testing.assert_allclose(got["r"], want.groupby("k")["v"].rank())
    np.testing.assert_allclose(got["p"], want.groupby("k")["v"].rank(pct=True, ascending=False))


def test_global_rank(spark, both_slicings):
    pdf, df = sample(spark)
    got = collect(average_rank(df, [], "v", "r", centred=True), "id")
    want = pdf.sort_values("id")["v"].rank()
    np.testing.assert_allclose(got["r"], want - (pdf["v"].count() + 1) / 2)


def test_quantiles_match_pandas(spark, both_slicings):
    pdf, df = sample(spark)
    got = collect(quantiles(df, ["k"], "v", {"a": 0.01, "b": 0.5, "c": 0.987}), "k").set_index("k")
    want = pdf.groupby("k")["v"].quantile([0.01, 0.5, 0.987]).unstack()
    np.testing.assert_allclose(got.to_numpy(), want.loc[got.index].to_numpy())


def test_row_positions_and_running_totals(spark, both_slicings):
    pdf, df = sample(spark)
    got = collect(row_positions(df, ["k"], "v", "id", "pos"), "k", "pos")
    want = pdf.dropna().sort_values(["k", "v", "id"])
    assert got["id"].tolist() == want["id"].tolist()
    cum = collect(ordered_counts(df, ["k"], "v", ones=F.sum(F.lit(1))), "k", "v")
    assert (cum["cum_ones"] == cum["last_pos"]).all() and (cum["total_ones"] == cum["total"]).all()


@pytest.mark.parametrize("wide", [100, 4], ids=["own-frames", "block-states"])
def test_rolling_frames_match_pandas(spark, monkeypatch, wide):
    monkeypatch.setattr(columns, "WIDE", wide)
    g = np.random.default_rng(1)
    pdf = pd.DataFrame({"ticker": np.repeat(["a", "b"], 90), "date": np.tile(pd.bdate_range("2020-01-01", periods=90).date, 2),
                        "x": g.normal(100, 2, 180), "y": g.normal(0, 1, 180)})
    pdf.loc[[5, 40, 100], "x"] = np.nan
    pdf.loc[50:75, "y"] = 3.0
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None)))
    fr = Frames()
    cols = {"m": fr.roll(F.avg, "x", 10), "s": fr.roll(F.stddev_samp, "x", 10, 4), "vy": fr.roll(F.var_samp, "y", 10),
            "mx": fr.roll(F.max, "x", 7), "mn": fr.roll(F.min, "x", 30, 3), "k": fr.count("x", 45).cast("double"), "t": fr.roll(F.sum, "x", 89, 2), "b": fr.beta("y", "x", 12), "c": fr.corr("y", "x", 12)}
    got = collect(fr.add(df, cols), "ticker", "date")
    want = pdf.sort_values(["ticker", "date"]).reset_index(drop=True)
    by = want.groupby("ticker")
    flat = lambda s: s.reset_index(level=0, drop=True).sort_index()
    np.testing.assert_allclose(got["m"], flat(by["x"].rolling(10).mean()), atol=1e-9)
    np.testing.assert_allclose(got["s"], flat(by["x"].rolling(10, min_periods=4).std()), atol=1e-8)
    np.testing.assert_allclose(got["mx"], flat(by["x"].rolling(7).max()))
    np.testing.assert_allclose(got["mn"], flat(by["x"].rolling(30, min_periods=3).min()))
    np.testing.assert_allclose(got["k"], flat(by["x"].rolling(45, min_periods=0).count()))
    np.testing.assert_allclose(got["t"], flat(by["x"].rolling(89, min_periods=2).sum()), atol=1e-9)
    assert (got["vy"][60:76] == 0).all()  # a constant window has exactly no variance
    cov = pd.concat([d["y"].rolling(12).cov(d["x"]) for _, d in by])
    corr = pd.concat([d["y"].where(d["x"].notna()).rolling(12).corr(d["x"]) for _, d in by])
    ok = got["c"].notna()
    np.testing.assert_allclose(got["c"][ok], corr[ok], atol=1e-6)
    assert got["b"].notna().sum() == cov.notna().sum()


def test_asof_join_takes_latest(spark):
    left = spark.createDataFrame([("a", 5), ("a", 9), ("b", 1)], "k string, d int")
    right = spark.createDataFrame([("a", 4, 1.0), ("a", 9, 2.0), ("b", 2, 3.0)], "k string, d int, v double")
    assert [r.v for r in asof_join(left, right, ["k"], "d").orderBy("k", "d").collect()] == [1.0, 2.0, None]


def test_stage_uses_shared_folder_setting(spark, shared_folder):
    before = len(list(shared_folder.rglob("*.parquet")))
    out = stage(spark.range(5).withColumn("x", F.col("id") * 2), "t")
    assert out.count() == 5 and len(list(shared_folder.rglob("*.parquet"))) > before


def test_tidy_has_no_negative_zero(spark):
    v = spark.range(1).select(tidy(F.lit(-1e-9)).alias("a"), tidy(F.lit(1.2345674)).alias("b")).first()
    assert str(v.a) == "0.0" and v.b == 1.234567
