"""Parsing of event times and the keys that hours are counted by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The input format and the bucket formats.
EVENT_TIME = "EEE MMM dd HH:mm:ss Z yyyy"
MONTH_DAY_HOUR, YEAR_TO_HOUR = "M/dd HH", "yyyyMMddHH"


def parsed(text: Column) -> Column:
    """The instant of a text like `Sun Jan 23 00:00:00 +0000 2011`; null if it isn't one. The weekday isn't read."""
    return F.try_to_timestamp(F.substring(text, 5, 100), F.lit(EVENT_TIME[4:]))


def bucket(ts: Column, fmt: str, tz: str | None = None, session_tz: str = "UTC") -> Column:
    """The hour of a timestamp as text; tz: the zone to write it in, if not the session's."""
    return F.date_format(F.convert_timezone(F.lit(session_tz), F.lit(tz), ts.cast("timestamp_ntz")) if tz else ts, fmt)
