"""All checkable queries and their SQL."""

from wayline.plans import catalog_matching, catalog_sequences, catalog_sources, catalog_text  # noqa: F401
from wayline.plans.catalog_base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
