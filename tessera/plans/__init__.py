"""Queries over the driver's tables."""

from tessera.plans import ledger_queries, promotion_queries, queries, retrieval_queries, run_queries, vault_queries, work_queries  # noqa: F401  (they register their queries)
from tessera.plans.registry import ORACLES, QUERIES  # noqa: F401
