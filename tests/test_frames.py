"""Frames over arrays: rows that go on in the next batch, lags, rows held, and the plan of the core features."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.functions import Frames
from panelloom.operators import features
from tests.conftest import collect


@pytest.fixture()
def uneven(spark):
    """Instruments of 1 to 40 rows, one without a name, gaps and an odd value; batches of 7 rows."""
    g = np.random.default_rng(3)
    parts = [pd.DataFrame({"ticker": t, "date": pd.bdate_range("2021-01-04", periods=n).date, "x": g.normal(5, 2, n), "y": g.normal(0, 1, n),
                           "live": g.random(n) < 0.7}) for t, n in (("a", 40), ("b", 1), ("c", 33), (None, 20), ("d", 3))]
    pdf = pd.concat(parts, ignore_index=True)
    pdf.loc[g.random(len(pdf)) < 0.15, "x"] = np.nan
    pdf.loc[7, "x"], pdf.loc[50:62, "y"] = 1e12, 3.0
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    df = spark.createDataFrame(pdf, "ticker string, date date, x double, y double, live boolean").withColumn("x", F.nanvl("x", F.lit(None)))
    yield pdf, df
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("lag", [False, True])
def test_lag_and_held_rows_match_pandas(uneven, lag):
    pdf, df = uneven
    fr = Frames(lag=lag)
    got = collect(fr.add(df, {
        "m": fr.roll(F.avg, "x", 5, 2), "s": fr.roll(F.stddev_samp, "x", 6, 3), "flat": fr.roll(F.stddev_samp, "y", 4),
        "b": fr.beta("y", "x", 4, only="live"), "h": fr.beta("y", "x", 4, only="live", held=True, default=1.0)}, ["ticker", "date"]), "ticker", "date")
    assert "live" not in got.columns
    frame = lambda d, i, n: d.iloc[max(0, i - n + 1):i + 1]
    each = lambda d, n, fn: pd.Series([fn(frame(d, i, n)) for i in range(len(d))], d.index, dtype=float)
    value = lambda v, need, fn: fn(v.dropna().to_numpy()) if v.count() >= need else np.nan
    slope = lambda d: np.cov(d["x"], d["y"])[0, 1] / np.var(d["x"], ddof=1) if len(d.dropna(subset=["x", "y"])) == 4 else np.nan
    want = []
    for _, d in pdf.groupby("ticker", dropna=False):
        d = d.sort_values("date")
        live = d[d["live"]]
        b = each(live, 4, slope)
        out = pd.DataFrame({
            "m": each(d["x"], 5, lambda v: value(v, 2, np.mean)), "s": each(d["x"], 6, lambda v: value(v, 3, lambda a: np.std(a, ddof=1))),
            "flat": each(d["y"], 4, lambda v: value(v, 4, lambda a: np.std(a, ddof=1) if np.ptp(a) else 0.0)),
            "b": b.reindex(d.index), "h": b.fillna(1.0).reindex(d.index).ffill()}, d.index)
        want.append(pd.concat([d[["ticker", "date"]], out.shift(1) if lag else out], axis=1))
    want = pd.concat(want).sort_values(["ticker", "date"]).reset_index(drop=True)
    for k in ("m", "s", "flat", "b", "h"):
        np.testing.assert_allclose(got[k].astype(float), want[k].astype(float), rtol=1e-6, atol=1e-9)
    # no deviation where all values are equal
    assert (got["flat"] == 0.0).any()


def test_core_features_cross_one_exchange(panel):
    """Frames are no windows of Spark, which go over every frame's rows for each row; rows are dealt once."""
    ctx = panel.groupBy("date").agg(F.avg(F.lit(0.001)).alias("ctx_ret"))
    plan = features.core_features(panel, F.broadcast(ctx))._jdf.queryExecution().executedPlan().toString()
    plan = plan.replace("AdaptiveSparkPlan", "")
    assert plan.count("hashpartitioning(ticker") == 1
    assert "RowFrame, -59" not in plan and "RowFrame, -19" not in plan
