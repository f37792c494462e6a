"""Every operator as a query over the generated tables, with its DuckDB twin."""

from costdocs.checks import cost, decisions, text, vectors  # noqa: F401
from costdocs.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
