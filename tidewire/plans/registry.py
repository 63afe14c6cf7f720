"""Every named query of the library with its DuckDB oracle."""

from __future__ import annotations

from tidewire.plans import briefs, chatting, connecting, ingestion, intelligence, language, listing, scalars, searching, serving, sources

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (listing, scalars, ingestion, searching, language, intelligence, briefs, connecting, serving, sources, chatting):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
