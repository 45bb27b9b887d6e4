"""Registered queries with the SQL that checks them."""

from prosa.checks import core, gold, live, logs  # noqa: F401  (importing registers)
from prosa.checks.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
