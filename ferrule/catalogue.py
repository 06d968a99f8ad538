"""All registered queries of the engine with their DuckDB oracles, gathered from ferrule.plans."""

from __future__ import annotations

from ferrule.plans import aggregates, catalogs, changes, dialect, joins, scalars, scans, scripts, sets, windows

_MODULES = (scans, joins, aggregates, windows, sets, scalars, changes, catalogs, dialect, scripts)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
