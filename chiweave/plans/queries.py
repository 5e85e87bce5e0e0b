"""All queries of the engine; importing the families registers them."""

from . import spectra_queries, structure_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
