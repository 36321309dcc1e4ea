"""All queries of the core engine by name, with their checking SQL."""

from __future__ import annotations

from spotloom.plans import domain, domain_sql, problems

QUERIES = {**domain.QUERIES, **problems.QUERIES}
ORACLE = {**domain_sql.ORACLE, **problems.ORACLE}
FLAGSHIP = "redemux_cell_counts"
