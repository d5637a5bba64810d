"""All queries of the tempo operators by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pulsegrid.plans import board, catalogue, decisions, evidence, families, hypotheses, ownership, routing, selectors, series, sessions, signals

_MODULES = (board, catalogue, families, selectors, decisions, series, hypotheses, routing, ownership, evidence, sessions, signals)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
