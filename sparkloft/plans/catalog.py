"""All queries of the relational part by name."""

from __future__ import annotations

from sparkloft.functions import nested, scalar, table_arguments, udfs, variants
from sparkloft.operators import aggregates, basics, joins, recursion, sets, sketches, vector_index, windows
from sparkloft.plans.registry import ORACLE_SQL, QUERIES
from sparkloft.sources import formats
from sparkloft.streaming import event_time, streams, timers

__all__ = ["ORACLE_SQL", "QUERIES", "aggregates", "basics", "event_time", "formats", "joins", "nested", "recursion", "scalar", "sets", "sketches", "streams", "table_arguments", "timers", "udfs", "variants", "vector_index", "windows"]
