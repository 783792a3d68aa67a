"""All queries of the core, with the SQL that gives the same rows."""

from __future__ import annotations

from lamina.plans import corpus, law, references, retrieval

_MODULES = (retrieval, corpus, law, references)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
