"""The walk-forward run: out of sample, selection size, weights; steps that stream in order."""

from dataclasses import replace
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.functions.sequence import walk
from panelloom.operators import boosting, portfolio, walkforward
from panelloom.operators.boosting import Params

NAMES = [f"t{i:02d}" for i in range(30)]
PLAN = walkforward.Plan(train_years=1, horizon=20, embargo=5, min_rows=200, least=4, members=2, params=Params(depth=2, rounds=4, rate=0.3, min_child=10, gamma=0.05))


@pytest.fixture(scope="module")
def market():
    g = np.random.default_rng(5)
    days = pd.bdate_range("2001-01-01", periods=400)
    rows = pd.MultiIndex.from_product([days.date, NAMES], names=["date", "ticker"]).to_frame(index=False)
    signal = g.random(len(rows))
    rows["f0"] = rows.assign(v=signal).groupby("date").v.rank(pct=True)
    rows["f1"] = rows.assign(v=g.random(len(rows))).groupby("date").v.rank(pct=True)
    rows["target"] = rows.assign(v=signal + 0.5 * g.random(len(rows))).groupby("date").v.rank(pct=True)
    rows.loc[rows.date > days[-21].date(), "target"] = np.nan
    rows["close"], rows["volume"], rows["ret"] = 100.0, 1e6, g.normal(0, 0.01, len(rows))
    return rows


def run(spark, rows):
    df = spark.createDataFrame(rows).withColumn("target", F.nanvl("target", F.lit(None).cast("double")))
    sectors = spark.createDataFrame([(t, "AB"[i % 2]) for i, t in enumerate(NAMES)], "ticker string, sector string")
    bench = spark.createDataFrame([("A", 0.5), ("B", 0.5)], "sector string, benchmark_weight double")
    return walkforward.run(df.select("date", "ticker", "f0", "f1"), ["f0", "f1"], df, df.select("date", "ticker", "close", "volume"),
                           df.select("date", "ticker", "ret"), sectors, bench, None, PLAN)


def test_run_is_out_of_sample_and_whole(spark, market):
    got = run(spark, market)
    fits = got["fits"].toPandas()
    assert (fits.trees > 0).all() and (fits.valid_ic > 0.5).all() and set(fits.member) == {0, 1}
    scores = got["scores"].toPandas()
    months = sorted(scores.date.unique())
    assert len(months) >= 4 and (scores.groupby("date").ticker.nunique() == 30).all()
    joined = scores.merge(market, on=["date", "ticker"])
    assert joined.groupby("date").apply(lambda x: x.score.rank().corr(x.f0.rank()), include_groups=False).median() > 0.2  # of five days' mean, one day is the date's own
    # What happens after a split's training end changes nothing at its prediction date.
    first = months[0]
    later = market.copy()
    later.loc[later.date > first - timedelta(days=26), "target"] = 0.5
    again = run(spark, later)["scores"].where(F.col("date") == F.lit(first)).toPandas()
    pd.testing.assert_frame_equal(again.sort_values("ticker").reset_index(drop=True), scores[scores.date == first].sort_values("ticker").reset_index(drop=True))
    held = got["holdings"].toPandas()
    assert (held.groupby("rebal_date").size() == max(4, int(30 * 0.15))).all()
    weights = got["weights"].toPandas()
    assert np.allclose(weights.groupby("rebal_date").weight.sum(), 1)
    assert got["monthly"].count() > 0


def test_steps_see_their_state_in_order(spark):
    rows = [(g, d, f"n{k}") for g in range(3) for d in range(5) for k in range(40)]
    df = spark.createDataFrame(rows, "g int, d int, n string").repartition(7)

    def step(state, key, at, part):
        state = [*(state or []), int(at)]
        return state, pd.DataFrame({"g": [key], "d": [at], "seen": [",".join(map(str, state))], "n": [len(part)]})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        got = walk(df, "g", "d", ["n"], step, "g int, d int, seen string, n int").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == [(g, d, ",".join(map(str, range(d + 1))), 40) for g in range(3) for d in range(5)]
    assert walk(df.limit(0), "g", "d", ["n"], step, "g int, d int, seen string, n int").count() == 0


def test_selection_size_follows_the_names(spark):
    rows = [(date(2001, 1, 1), f"a{i:03d}", 1 - i / 100) for i in range(100)] + [(date(2001, 2, 1), f"a{i:03d}", i / 100) for i in range(50)]
    got = portfolio.dynamic_schedule(spark.createDataFrame(rows, "date date, ticker string, score double"), least=3, emergency_rank=20).toPandas()
    size = got.groupby("rebal_date").ticker.nunique()
    assert size[date(2001, 1, 1)] == 15 and size[date(2001, 2, 1)] == 7
    assert set(got[got.rebal_date == date(2001, 2, 1)].ticker) == {f"a{i:03d}" for i in range(43, 50)}
