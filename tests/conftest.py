import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from panelloom.functions import order_stats
from panelloom.session import local_session


@pytest.fixture(scope="session")
def shared_folder(tmp_path_factory):
    return tmp_path_factory.mktemp("shared")


@pytest.fixture(scope="session")
def spark(shared_folder):
    return local_session(4, memory="6g", **{"spark.checkpoint.dir": str(shared_folder)})


@pytest.fixture(params=[None, 7], ids=["usual-slices", "seven-values-a-slice"])
def both_slicings(request, monkeypatch):
    """Run a test with the usual slices and with many small ones."""
    if request.param:
        cut = order_stats._sliced
        monkeypatch.setattr(order_stats, "_sliced", lambda df, keys, value, _: cut(df, keys, value, request.param))


def ohlcv(ticker, n=160, seed=42, start="2022-01-03"):
    g = np.random.default_rng(seed)
    close = 100 * np.cumprod(1 + g.normal(0.0004, 0.015, n))
    opening = np.r_[close[0], close[:-1]] * (1 + g.normal(0, 0.003, n))
    return pd.DataFrame({
        "date": pd.bdate_range(start, periods=n).date, "ticker": ticker, "open": opening,
        "high": np.maximum(opening, close) * 1.004, "low": np.minimum(opening, close) * 0.996, "close": close,
        "volume": np.round(np.abs(g.normal(1e6, 2e5, n)))})


@pytest.fixture(scope="session")
def panel_pd():
    return pd.concat([ohlcv(t, seed=42 + i) for i, t in enumerate(["AAA", "BBB", "CCC", "DDD"])], ignore_index=True)


@pytest.fixture(scope="session")
def panel(spark, panel_pd):
    return spark.createDataFrame(panel_pd).cache()


def collect(df, *order):
    out = df.toPandas()
    return out.sort_values(list(order)).reset_index(drop=True) if order else out
