"""All registered queries over the given tables."""

from . import consensus, editions, layout, recipes, reports, review, search, structure, usage
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "consensus", "editions", "layout", "recipes", "reports", "review", "search", "structure", "usage"]
