"""Registered queries: operators bound to the given tables, with their SQL."""

from . import curation, evaluation, ranking  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
