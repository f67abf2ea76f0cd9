"""The corpus queries by name, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from . import bpe, divergence, embeddings, fingerprints, jaccard, languages, licenses, lm, mixing, secrets, substrings, toxicity

MODULES = (secrets, fingerprints, mixing, bpe, toxicity, jaccard, embeddings, lm, licenses, substrings, languages, divergence)
QUERIES: dict = {}
ORACLES: dict = {}
for module in MODULES:
    QUERIES |= module.QUERIES
    ORACLES |= getattr(module, "ORACLES", {})
