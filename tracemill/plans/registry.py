"""All registered queries and their DuckDB forms."""

from __future__ import annotations

from . import catalog, catalog_reports, oracle, oracle_reports

QUERIES = catalog.QUERIES | catalog_reports.QUERIES
ORACLE = oracle.ORACLE | oracle_reports.ORACLE
