"""All registered queries of the library, and the SQL that checks them."""

from leafquire import catalog_build, catalog_search
from leafquire.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog_build", "catalog_search"]
