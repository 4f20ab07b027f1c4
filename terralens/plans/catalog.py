"""All queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from terralens.plans import asking, auditing, building, collecting, places, reporting, splits

QUERIES = {**splits.QUERIES, **places.QUERIES, **asking.QUERIES, **auditing.QUERIES, **reporting.QUERIES, **collecting.QUERIES, **building.QUERIES}
ORACLE = {**splits.ORACLE, **places.ORACLE, **asking.ORACLE, **auditing.ORACLE, **reporting.ORACLE, **collecting.ORACLE, **building.ORACLE}
