"""Time columns: relative ages and dates. `now` is always a parameter."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekspan.functions.paths import col

# how callers may give a point in time
Moment = Column | str | datetime

MINUTE = 60 * 1_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def moment(value: Moment) -> Column:
    """A point in time given as a column, a text or a datetime."""
    return (value if isinstance(value, Column) else F.lit(value)).cast("timestamp")


def relative_time(ts: Column | str, now: Moment) -> Column:
    """P15: 'just now', minutes, hours, days, or the date from 30 days on."""
    t = col(ts).cast("timestamp")
    age = F.unix_micros(moment(now)) - F.unix_micros(t)
    whole = lambda unit: F.floor(age / F.lit(unit)).cast("string")
    return (
        F.when(age < MINUTE, F.lit("just now"))
        .when(age < HOUR, F.concat(whole(MINUTE), F.lit(" min ago")))
        .when(age < DAY, F.concat(whole(HOUR), F.lit(" hours ago")))
        .when(age < 30 * DAY, F.concat(whole(DAY), F.lit(" days ago")))
        .otherwise(F.date_format(t, "yyyy-MM-dd"))
    )


def parse_stamp(c: Column | str) -> Column:
    """Timestamp from text or a timestamp column; null when it cannot be read."""
    return F.try_to_timestamp(col(c).cast("string"))


def stamp_date(c: Column | str) -> Column:
    """Date of a stamp, or 'unknown'."""
    return F.coalesce(F.date_format(parse_stamp(c), "yyyy-MM-dd"), F.lit("unknown"))


def stamp_text(c: Column | str) -> Column:
    """Second-precision UTC stamp with a 'Z'."""
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
