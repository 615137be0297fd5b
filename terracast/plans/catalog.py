"""All registered queries."""
from terracast.plans import queries_quality, queries_match, queries_space, queries_scores, queries_serve, queries_models, queries_files  # noqa: F401
from terracast.plans.registry import ORACLES, QUERIES  # noqa: F401
