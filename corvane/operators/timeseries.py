"""Hourly counts of events, all of them or those with a keyword."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import contains_any
from corvane.functions.time import MONTH_DAY_HOUR, bucket, parsed


def hourly_counts(events: DataFrame, ts: Column, fmt: str = MONTH_DAY_HOUR, tz: str | None = None) -> DataFrame:
    """(hour, cnt) of events with a time; fmt writes the hour."""
    return events.select(bucket(ts, fmt, tz).alias("hour")).where("hour is not null").groupBy("hour").agg(F.count("*").alias("cnt"))


def with_keyword(events: DataFrame, text: str, keywords: list[str]) -> DataFrame:
    """The events whose text contains one of the lower-case keywords, whatever its case."""
    return events.where(contains_any(F.col(text), keywords))


def matching(events: DataFrame, text: str, keywords: list[str]) -> DataFrame:
    """The same by a case-insensitive pattern."""
    return events.where(F.col(text).rlike("(?i)" + "|".join(keywords)))


def parsed_events(events: DataFrame, created: str = "creationtime") -> DataFrame:
    """events with their time in column ts; rows whose time can't be read are left out."""
    return events.withColumn("ts", parsed(F.col(created))).where("ts is not null")


def month_day_hour_counts(events: DataFrame, ts: Column) -> DataFrame:
    """(month, day, hour, cnt)."""
    keys = [F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"), F.hour(ts).alias("hour")]
    return events.where(ts.isNotNull()).groupBy(*keys).agg(F.count("*").alias("cnt"))
