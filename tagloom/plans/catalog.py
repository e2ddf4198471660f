"""Everything registered: importing this module fills the registry."""

from tagloom.plans import asset_queries, file_queries, tag_queries  # noqa: F401
from tagloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
