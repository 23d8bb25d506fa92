"""All queries of this subpackage and their SQL, for registration."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
