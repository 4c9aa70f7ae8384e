"""All registered queries of the reference's own operators."""

from __future__ import annotations

from vidlake.plans import behaviour, decode, embed, flow

MODULES = (behaviour, flow, decode, embed)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
