"""Registered queries: every operator over the driver tables, with its oracle SQL."""

from . import evaluation, models, preparation, profiling, scoring, streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
