"""The end-to-end run: panel, features, scores, monthly schedule, backtest, monthly returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions import calendar, percent_rank, stage
from panelloom.operators import backtest, features, universe, xsection
from panelloom.operators.portfolio import top_k_schedule
from panelloom.sources.tables import Tables

SIGNALS = ["return_1m", "bollinger_distance", "volatility_regime"]


def research_run(t: Tables, ks: list[int], cfg: backtest.Config = backtest.Config(capital=100_000.0)) -> dict[str, DataFrame]:
    """Every table of the run.  Features and scores feed several branches and are staged."""
    panel = stage(t.panel(), "panel")
    core = stage(features.core_features(panel).select("date", "ticker", *SIGNALS), "signals")
    z = xsection.zscore(core, SIGNALS)
    blend = z.select("date", "ticker", sum((F.col(s) for s in SIGNALS), F.lit(0.0)).alias("blend")).dropna()
    scores = stage(percent_rank(blend, ["date"], "blend", "score").select("date", "ticker", "score"), "scores")
    weights = stage(top_k_schedule(scores, ks), "weights")
    returns = features.prepare(panel, None).select("date", "ticker", F.col("_ret").alias("ret")).where("ret is not null")
    daily = stage(backtest.run(weights, returns, calendar(panel), None, universe.traded_value(panel, names=weights), cfg), "daily")
    return {
        "scores": scores, "weights": weights, "daily": daily, "metrics": backtest.full_metrics(daily, None, cfg),
        "rolling": backtest.rolling_metrics(daily, cfg), "monthly": backtest.monthly_returns(daily),
    }
