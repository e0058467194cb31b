"""Time-of-day and calendar expressions.

Hours are counted as whole hours since 1970-01-01 in local wall time, taken
from the date and the hour field. That needs no time zone, so a session in a
zone with daylight saving gives the same spans as one in UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOCK = r"^([01]?[0-9]|2[0-3]):([0-5]?[0-9])$"


def clock_hour(text: Column) -> Column:
    """``HH:MM`` as a fractional hour; anything else is null."""
    part = F.split(text, ":")
    return F.when(text.rlike(_CLOCK),
                  part.getItem(0).cast("double") + part.getItem(1).cast("double") / F.lit(60.0))


def hour_bucket(hour: Column) -> Column:
    """Nearest whole hour, ties to even; 23:45 goes to 24."""
    return F.rint(hour).cast("int")


def week_of(date: Column) -> Column:
    """Week index of a date: day of year over seven, 0 to 52."""
    return F.floor(F.dayofyear(date) / F.lit(7)).cast("int")


def day_index(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long")


def hour_index(ts: Column) -> Column:
    """Whole hours since 1970-01-01, wall time."""
    return day_index(ts.cast("date")) * F.lit(24) + F.hour(ts)


def span_hours(date: Column, hour: Column, duration_hrs: Column) -> tuple[Column, Column]:
    """First and last hour index an outing touches, both inclusive."""
    day = day_index(date) * F.lit(24)
    # microsecond rounding, so 8.3 h + 0.7 h ends at 9:00 and not just after
    ends = F.round((hour + duration_hrs) * F.lit(3600.0), 6) / F.lit(3600.0)
    return day + F.floor(hour), day + F.ceil(ends)


def at_hour(date: Column, hours: Column) -> Column:
    """Local timestamp ``hours`` after midnight of ``date``."""
    secs = F.round(hours * F.lit(3600.0), 6).cast("decimal(18,6)")
    zero = F.lit(0)
    return date.cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, secs)
