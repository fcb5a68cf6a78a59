"""All registered queries with the SQL they are checked against."""

from limner.catalog import data, evaluation, rules, runs, streams  # noqa: F401
from limner.catalog.registry import REGISTRY

__all__ = ["REGISTRY"]
