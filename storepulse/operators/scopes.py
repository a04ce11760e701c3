"""Who and what a report covers: windows, cameras, staff, pages of lists."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at(moment: datetime | str) -> Column:
    return F.lit(str(moment)).cast("timestamp_ntz")


def within(df: DataFrame, column: str, start, end) -> DataFrame:
    """Rows from start to end, both included; literals, so they reach the scan."""
    return df.filter((F.col(column) >= at(start)) & (F.col(column) <= at(end)))


def cameras_in_scope(cameras: DataFrame, camera_id: int | None = None, store_id: int | None = None) -> DataFrame:
    """camera_id of the scope: the camera if given, else the store's cameras, else all. A store without cameras gives none."""
    if camera_id is not None:
        cameras = cameras.filter(F.col("camera_id") == camera_id)
    elif store_id is not None:
        cameras = cameras.filter(F.col("store_id") == store_id)
    return cameras.select("camera_id").distinct()


def in_scope(df: DataFrame, scope: DataFrame | None) -> DataFrame:
    return df if scope is None else df.join(scope, "camera_id", "left_semi")


def seen_in_window(persons: DataFrame, sessions: DataFrame, start, end, scope: DataFrame | None = None) -> DataFrame:
    """Persons with a session that starts in the window (and in scope)."""
    seen = in_scope(within(sessions, "started_at", start, end), scope).select("person_id")
    return persons.join(seen, "person_id", "left_semi")


def not_staff(facts: DataFrame, persons: DataFrame) -> DataFrame:
    """Facts of persons who are known and not staff; facts without person go, as SQL's NOT IN has it."""
    staff = persons.filter("is_staff").select("person_id")
    return facts.filter("person_id IS NOT NULL").join(staff, "person_id", "left_anti")


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of a list; order ends with the key."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def total_pages(df: DataFrame, size: int = 20) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.ceil(F.count("*") / size).cast("long").alias("pages"))


def search(df: DataFrame, columns: list[str], text: str, prefix: bool = False) -> DataFrame:
    """Rows where a column contains (or starts with) the text, whatever its case; % and _ of the text are plain."""
    plain = text.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    pattern = plain + "%" if prefix else f"%{plain}%"
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).cast("string").ilike(pattern), F.lit(False))
    return df.filter(hit)


def list_events(
    events: DataFrame, camera_id=None, zone_id=None, person_id=None, event_type=None, severity=None, acknowledged=None, start=None, end=None, false_positives: bool = False,
) -> DataFrame:
    """Events under any of eight filters; false positives only if asked for."""
    for name, value in (("camera_id", camera_id), ("zone_id", zone_id), ("person_id", person_id), ("event_type", event_type), ("severity", severity), ("is_acknowledged", acknowledged)):
        if value is not None:
            events = events.filter(F.col(name) == value)
    if start is not None:
        events = events.filter(F.col("occurred_at") >= at(start))
    if end is not None:
        events = events.filter(F.col("occurred_at") <= at(end))
    return events if false_positives else events.filter(~F.col("is_false_positive"))


def list_billing(billing: DataFrame, camera_id=None, person_id=None, start=None, end=None) -> DataFrame:
    for name, value in (("camera_id", camera_id), ("person_id", person_id)):
        if value is not None:
            billing = billing.filter(F.col(name) == value)
    if start is not None:
        billing = billing.filter(F.col("entered_at") >= at(start))
    return billing if end is None else billing.filter(F.col("entered_at") <= at(end))


def list_objects(objects: DataFrame, storage_type=None, camera_id=None) -> DataFrame:
    for name, value in (("storage_type", storage_type), ("camera_id", camera_id)):
        if value is not None:
            objects = objects.filter(F.col(name) == value)
    return objects
