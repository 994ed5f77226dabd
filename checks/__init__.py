"""Queries over the test tables, each with the SQL that must give the same rows."""

from . import base, charts, findings, wording  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
