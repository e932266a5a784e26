"""Times as whole microseconds and back, for either timestamp type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = 86_400_000_000


def micros(time: Column, kind: T.DataType) -> Column:
    """Microseconds since 1970.  A time without a zone is counted on its own clock, whatever the session's zone."""
    if not isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(time.cast("timestamp"))
    whole = F.unix_date(time.cast("date")).cast("long") * DAY
    hours = F.hour(time).cast("long") * 3600 + F.minute(time) * 60
    return whole + hours * 1_000_000 + (F.date_part(F.lit("SECOND"), time) * 1_000_000).cast("long")


def from_micros(us: Column, kind: T.DataType) -> Column:
    """The time of a type that ``micros`` counted."""
    if not isinstance(kind, T.TimestampNTZType):
        return F.timestamp_micros(us).cast(kind)
    days = F.floor(us / F.lit(DAY))
    rest = F.pmod(us, F.lit(DAY)).cast("decimal(18,0)") / F.lit(1_000_000)
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    return start + F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), rest.cast("decimal(18,6)"))
