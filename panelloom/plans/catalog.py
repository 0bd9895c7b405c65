"""All registered queries."""

from panelloom.plans import q_alpha, q_backtest, q_features, q_models, q_monitor, q_risk, q_walk  # noqa: F401
from panelloom.plans.registry import ORACLES, QUERIES  # noqa: F401
