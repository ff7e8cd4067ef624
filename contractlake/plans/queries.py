"""All registered queries: importing this module registers them."""

from contractlake.plans import review_queries, round_trip_queries, rule_queries, text_queries
from contractlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "review_queries", "round_trip_queries", "rule_queries", "text_queries"]
