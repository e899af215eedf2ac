"""All registered queries."""

from tidepanel.plans import asof_queries, derived_queries, factor_queries, fundamental_queries, gate_queries, holdout_queries, identity_queries, import_queries, more_queries, observable_queries, panel_queries, source_queries, store_queries, stream_queries, trading_queries  # noqa: F401
from tidepanel.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
