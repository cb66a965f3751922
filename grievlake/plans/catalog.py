"""All registered queries. Importing the modules fills the registry."""

from __future__ import annotations

from . import flow_queries, hotspot_queries, legal_queries, retrieval_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
