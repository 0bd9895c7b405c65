"""Steps over whole instruments or whole dates that follow one another cross one exchange."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelloom.functions import Frames
from panelloom.operators import features
from tests.conftest import collect


def exchanges(df, key):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count(f"hashpartitioning({key}")


def test_all_families_cross_one_exchange(panel):
    ctx = panel.groupBy("date").agg(F.avg(F.lit(0.001)).alias("ctx_ret"))
    assert exchanges(features.compute_families(panel, F.broadcast(ctx)), "ticker") == 1


def test_other_rows_of_an_instrument_match_pandas(spark):
    """Batches of 7 rows; nulls, NaN and infinities are read as they are."""
    g = np.random.default_rng(5)
    pdf = pd.concat([pd.DataFrame({"ticker": t, "date": pd.bdate_range("2021-01-04", periods=n).date, "x": g.normal(5, 2, n)})
                     for t, n in (("a", 20), ("b", 1), (None, 9), ("d", 3))], ignore_index=True)
    pdf.loc[3, "x"] = np.inf
    gone = g.random(len(pdf)) < 0.3
    gone[[20, 30, 31, 32]] = True
    gone[3] = False
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.createDataFrame(pdf.assign(gone=gone), "ticker string, date date, x double, gone boolean").withColumn("x", F.when(~F.col("gone"), F.col("x")))
        fr = Frames()
        one = fr.add(df, {"p": fr.past("x", 2), "h": fr.held("x"), "t": fr.total("x"), "e": fr.ever("x")}, ["ticker", "date", "x"])
        fr.clear()
        got = collect(fr.add(one, {"pp": fr.past("p", 1)}, one.columns, dealt=True), "ticker", "date")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = []
    for _, d in pdf.assign(x=pdf["x"].where(~gone)).groupby("ticker", dropna=False):
        d = d.sort_values("date")
        seen = d["x"].notna().cummax()
        want.append(d.assign(p=d["x"].shift(2), h=d["x"].ffill(), t=d["x"].fillna(0).cumsum().where(seen), e=float(seen.any()), pp=d["x"].shift(3)))
    want = pd.concat(want).sort_values(["ticker", "date"]).reset_index(drop=True)
    for k in ("p", "h", "t", "e", "pp"):
        np.testing.assert_allclose(got[k].astype(float), want[k], rtol=1e-12)


def test_own_history_crosses_one_exchange(panel):
    from panelloom.operators import xsection

    df = panel.select("date", "ticker", "close", "volume")
    assert exchanges(xsection.own_history_zscore(df, ["close", "volume"]), "ticker") == 1
    core = features.core_features(panel, only=["volume_shock"]).select("date", "ticker", "volume_shock")
    assert exchanges(xsection.own_history_zscore(core, ["volume_shock"], dealt=True), "ticker") == 1
    want = collect(xsection.own_history_zscore(core, ["volume_shock"]), "ticker", "date")
    pd.testing.assert_frame_equal(collect(xsection.own_history_zscore(core, ["volume_shock"], dealt=True), "ticker", "date"), want)


def test_ranks_meet_their_targets_as_bins(spark):
    """What is staged for the join holds a byte a feature, and rows are those of a join of the ranks."""
    import os

    from panelloom.functions.staging import staging_root
    from panelloom.operators import boosting

    g = np.random.default_rng(2)
    pdf = pd.DataFrame([(d, t) for d in pd.bdate_range("2021-01-04", periods=6).date for t in "abcdef"], columns=["date", "ticker"])
    pdf["f0"], pdf["f1"] = g.integers(1, 7, len(pdf)) / 6, g.integers(1, 7, len(pdf)) / 6
    ranks = spark.createDataFrame(pdf).withColumn("f1", F.when(F.col("ticker") != "f", F.col("f1")))
    target = spark.createDataFrame(pdf.iloc[::2][["date", "ticker"]].assign(target=0.5))
    kept = lambda: {x for x in (os.listdir(staging_root(spark)) if os.path.isdir(staging_root(spark)) else []) if x.startswith("bins-")}
    before = kept()
    got = collect(boosting.binned(ranks, ["f0", "f1"], "target", 8, target), "day", "ticker")
    (made,) = kept() - before
    assert dict(spark.read.parquet(os.path.join(staging_root(spark), made)).dtypes) == {"date": "date", "ticker": "string", "b0": "tinyint", "b1": "tinyint"}
    want = collect(boosting.binned(ranks.join(target, ["date", "ticker"], "left"), ["f0", "f1"], "target", 8), "day", "ticker")
    pd.testing.assert_frame_equal(got, want)
    assert len(got) == 30 and got["y"].notna().sum() == 18
