"""All registered corpus queries; importing the module registers them."""

from millrace.llm import queries  # noqa: F401
from millrace.llm.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
