"""All core queries and their SQL, by name."""

from zonepulse.plans import basics, epidemiology, layers, mobility, reports  # noqa: F401
from zonepulse.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "weighted_risk_topn"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
