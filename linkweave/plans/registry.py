"""All registered queries and their SQL."""

from __future__ import annotations

from linkweave.plans import decoding, linking, modelling, records

_MODULES = (decoding, records, linking, modelling)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
