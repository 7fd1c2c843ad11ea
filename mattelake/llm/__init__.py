"""Operators for preparing training data; nothing else in the library imports this subpackage.

``QUERIES`` maps the registered query names to functions of (spark, sf_dir), ``ORACLES`` the names
whose rows DuckDB can compute to their SQL.
"""

from mattelake.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
