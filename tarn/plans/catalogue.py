"""All registered queries of the engine."""

from tarn.functions import arrays, dates, json, maths, strings
from tarn.operators import aggregates, changes, filters, joins, ordering, scans, sets, windows
from tarn.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "aggregates", "arrays", "changes", "dates", "filters", "joins", "json", "maths", "ordering", "scans", "sets", "strings", "windows"]
