"""All queries of the engine by key, and their SQL twins."""

from __future__ import annotations

from .plans import evaluation, files, ocean, rules, sinks, surface  # noqa: F401
from .plans.registry import ORACLES, QUERIES  # noqa: F401
