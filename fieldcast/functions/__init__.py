"""Column expressions. All of them are JVM built-ins, no Python UDF."""

from fieldcast.functions.clock import clock_hour, hour_bucket, hour_index, span_hours, week_of
from fieldcast.functions.numeric import logit_bucket, round_half_up_int, sigmoid, snap
from fieldcast.functions.place import haversine_km, in_box

__all__ = [
    "clock_hour", "hour_bucket", "hour_index", "span_hours", "week_of",
    "logit_bucket", "round_half_up_int", "sigmoid", "snap",
    "haversine_km", "in_box",
]
