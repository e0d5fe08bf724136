"""All registered queries: importing the ``q_*`` modules fills the registry.

Every query reads the driver tables (through the role views in ``roles``) and
runs the library operator over the whole table.  Double columns are rounded
for comparison only (``out`` in the query, ``rounded`` in the oracle).
"""

from __future__ import annotations

from vitalis.plans import q_agg, q_clean, q_core, q_metrics, q_ml, q_signal, q_sources, q_split  # noqa: F401
from vitalis.plans.q_core import q_metrics_by_entity_reg  # noqa: F401
from vitalis.plans.registry import REGISTRY, QueryFn


def queries() -> dict[str, QueryFn]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
