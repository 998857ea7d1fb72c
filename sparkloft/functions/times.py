"""Times without a zone, counted as they stand: results don't depend on the session's zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import TimestampType


def has_zone(rows: DataFrame, ts: str) -> bool:
    return isinstance(rows.schema[ts].dataType, TimestampType)


def micros(rows: DataFrame, ts: str) -> Column:
    """Microseconds since 1970; a time without a zone as if it were UTC."""
    return F.unix_micros(ts) if has_zone(rows, ts) else _micros(F.col(ts))


def _micros(c: Column) -> Column:
    seconds = F.unix_date(c.cast("date")).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def instant(c: Column) -> Column:
    """A time without a zone as an instant, by UTC: watermarks need one."""
    return F.timestamp_micros(_micros(c))


def unzoned(c: Column) -> Column:
    """What instant() came from."""
    return stood(F.unix_micros(c))


def stood(at: Column) -> Column:
    """The time without a zone that micros() has counted."""
    seconds = (at.cast("decimal(20,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
