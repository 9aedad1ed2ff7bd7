"""All registered queries."""
from .registry import ORACLES, QUERIES
from . import (  # noqa: F401
    q_extract,
    q_text,
    q_feeds,
    q_entities,
    q_metrics,
    q_graph,
    q_persona,
    q_streaming,
)

__all__ = ["ORACLES", "QUERIES"]
