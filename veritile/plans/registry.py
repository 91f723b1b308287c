"""Named queries over the test tables and the SQL that each must equal."""

from __future__ import annotations

from veritile.plans import queries

FLAGSHIP = "noise_flags"
QUERIES: dict = dict(queries.QUERIES)
ORACLE_SQL: dict = dict(queries.ORACLE_SQL)
