"""The jobs as queries, and their SQL twins."""

from __future__ import annotations

from . import harvest, transformation

QUERIES = transformation.QUERIES | harvest.QUERIES
ORACLES = transformation.ORACLES | harvest.ORACLES
