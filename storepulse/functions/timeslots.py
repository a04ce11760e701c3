"""Local-time slots. Instants are UTC without zone; reporting slots are of a fixed offset (0 or 330 minutes)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEPS = {"hour": "INTERVAL '1' HOUR", "day": "INTERVAL '1' DAY", "week": "INTERVAL '7' DAY", "month": "INTERVAL '1' MONTH"}


def local(ts: Column, offset_minutes: int = 330) -> Column:
    return ts + F.expr(f"make_dt_interval(0, 0, {offset_minutes}, 0)")


def slot(ts: Column, granularity: str = "hour", offset_minutes: int = 330) -> Column:
    """The start of the local slot (weeks start on Monday)."""
    return F.date_trunc(granularity, local(ts, offset_minutes)).cast("timestamp_ntz")


def slot_label(start: Column, granularity: str) -> Column:
    """2 PM, 14th Jul, 2024-W03 (weeks from the year's first Monday; days before it are week 00), 2024-07."""
    if granularity == "hour":
        return F.concat((F.pmod(F.hour(start) + 11, F.lit(12)) + 1).cast("string"), F.when(F.hour(start) < 12, " AM").otherwise(" PM"))
    if granularity == "day":
        d = F.dayofmonth(start)
        suffix = F.when(d.between(11, 13), "th").when(d % 10 == 1, "st").when(d % 10 == 2, "nd").when(d % 10 == 3, "rd").otherwise("th")
        return F.concat(d.cast("string"), suffix, F.lit(" "), F.date_format(start, "MMM"))
    if granularity == "week":
        week = F.floor((F.dayofyear(start) + 6 - F.weekday(start)) / 7)
        return F.concat(F.year(start).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
    return F.date_format(start, "yyyy-MM")


def spine(spark: SparkSession, start: str, end: str, granularity: str = "hour", offset_minutes: int = 330) -> DataFrame:
    """slot, position: every local slot from the one that holds start to the one that holds end."""
    at = [slot(F.lit(x).cast("timestamp_ntz"), granularity, offset_minutes) for x in (start, end)]
    return spark.range(1).select(F.posexplode(F.sequence(at[0], at[1], F.expr(STEPS[granularity])))).select(F.col("col").alias("slot"), F.col("pos").alias("position"))


def resolved(granularity: str, start: str, end: str) -> str:
    """auto is hour up to a day, else day; other granularities are themselves."""
    if granularity != "auto":
        return granularity
    return "hour" if datetime.fromisoformat(end) - datetime.fromisoformat(start) <= timedelta(days=1) else "day"


def resolve_range(kind: str, as_of: datetime, start: datetime | None = None, end: datetime | None = None, offset_minutes: int = 330) -> tuple[datetime, datetime, datetime, datetime]:
    """start, end, previous start, previous end in UTC of today, weekly or custom.

    today: since local midnight, against the same stretch a day before. weekly: the 7 days before today and today so far,
    against the 7 days before those. custom: against as long a stretch just before."""
    shift = timedelta(minutes=offset_minutes)
    midnight = (as_of + shift).replace(hour=0, minute=0, second=0, microsecond=0) - shift
    if kind == "today":
        return midnight, as_of, midnight - timedelta(days=1), as_of - timedelta(days=1)
    if kind == "weekly":
        first = midnight - timedelta(days=7)
        return first, as_of, first - timedelta(days=7), first
    if kind == "custom" and start is not None and end is not None:
        return start, end, start - (end - start), start
    raise ValueError(f"no such range: {kind}")


def default_range(as_of: datetime) -> tuple[datetime, datetime]:
    """The last 24 hours; both ends belong to it."""
    return as_of - timedelta(hours=24), as_of
