"""All registered queries of the core operators and their SQL."""

from lodestrata.plans import graphs, incremental, lookups, retrieval, sessions, textual

_PARTS = (lookups, textual, retrieval, graphs, sessions, incremental)
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLE = {name: q for part in _PARTS for name, q in part.ORACLE.items()}
