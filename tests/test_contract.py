import importlib
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from panelloom.plans.catalog import ORACLES, QUERIES
from tools.check import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "universe_point_in_time", "features_core", "features_sentiment", "xsection_zscore", "labels_classification", "quality_flags", "alpha_decile_spread",
    "backtest_daily", "portfolio_trade_costs", "risk_historical_var", "drift_psi", "monitor_alert_cooldown", "insight_news_sentiment", "execution_roll_up",
]


def test_contract_functions():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


def test_entry_works_without_the_corpus_operators(tmp_path):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "panelloom", tmp_path / "panelloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    say = "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"
    for extra in ((), ("corpus_pipeline.py",)):
        for name in extra:
            shutil.copy(root / name, tmp_path)
        out = subprocess.run([sys.executable, "-c", say], cwd=tmp_path, capture_output=True, text=True, check=True)
        assert out.stdout.split() == [str(len(QUERIES)), "False"]


def test_entry_yields_rows(spark):
    df = importlib.import_module("__spark_entry__").entry(spark)
    assert df.columns == ["portfolio_id", "month", "monthly_return"] and df.count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    con = connect(FOLDER)
    df = QUERIES[name](spark, FOLDER)
    want = con.execute(ORACLES[name])
    status = compare(df.columns, [tuple(r) for r in df.collect()], [d[0] for d in want.description], want.fetchall())
    assert status.startswith("ok"), status
