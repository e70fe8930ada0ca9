"""Query plans: each module registers named queries with their SQL oracle."""

from fraudlens.plans import dashboard, features, graph, io, learning, metrics, nearest, streams  # noqa: F401  (registers queries)
from fraudlens.plans.registry import HEADLINE, ORACLE, QUERIES  # noqa: F401
