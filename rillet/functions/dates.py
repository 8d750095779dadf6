"""Times are numbers: seconds for `now`, milliseconds elsewhere. Formats are Java's patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import builtin


@builtin("now/0")
def now() -> Column:
    return F.unix_millis(F.current_timestamp()) / 1000.0


@builtin("timestamp/0")
def timestamp() -> Column:
    return F.unix_millis(F.current_timestamp())


@builtin("strftime/1", "strftime/2")
def strftime(millis: Column, pattern: str, zone: str = "UTC") -> Column:
    """In the zone, whatever the session's is."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), _utc(millis)), pattern)


def _utc(millis: Column) -> Column:
    """The wall-clock time in UTC, without a zone."""
    return F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (millis / 1000).cast("decimal(18,6)"))


@builtin("strptime/1", "strptime/2")
def strptime(s: Column, pattern: str, zone: str = "UTC") -> Column:
    local = F.to_timestamp_ntz(s, F.lit(pattern))
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    return F.timestamp_diff("MILLISECOND", F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), utc)
