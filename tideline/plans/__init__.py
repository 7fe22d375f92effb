"""Importing the package registers every query."""

from . import decisions, hygiene, levels, live, outcomes, reports, risk, statistics, windows  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
