"""All registered queries; importing the modules registers them."""

from millrace.plans import clean_queries, explore_queries, feature_queries, model_queries, profile_queries, quality_queries  # noqa: F401
from millrace.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
