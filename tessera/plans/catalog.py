"""All core queries and their SQL."""

from __future__ import annotations

from tessera.plans import accounting, evaluation, maps, retrieval, sessions, sources, streams

_MODULES = (retrieval, maps, accounting, sessions, evaluation, streams, sources)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
