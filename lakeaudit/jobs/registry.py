"""Every query of the library by name, and the SQL of the same rows where SQL can state it."""

from __future__ import annotations

from lakeaudit.jobs import queries_advisories, queries_composition, queries_lifecycle, queries_quality, queries_reports, queries_scan, queries_sources
from lakeaudit.jobs.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "queries_advisories", "queries_composition", "queries_lifecycle", "queries_quality", "queries_reports", "queries_scan", "queries_sources"]
