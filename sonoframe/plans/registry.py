"""Named queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from sonoframe.plans import queries
from sonoframe.plans.sql import SQL
from sonoframe.plans.sql_more import SQL_MORE

QUERIES: dict = {n: f for n, f in vars(queries).items() if n.startswith("q") and callable(f)}
ORACLE_SQL: dict[str, str] = {n: s for n, s in (SQL | SQL_MORE).items() if n in QUERIES}
