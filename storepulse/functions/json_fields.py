"""Fields of semi-structured columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dwell_seconds(metadata: Column) -> Column:
    return F.get_json_object(metadata, "$.dwell_seconds").cast("double")


def has_key(metadata: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(metadata), key), F.lit(False))


def session_debug(column: Column) -> Column:
    """A struct tier, reason, score, frames from the object form; all null for the array form or another shape; blank strings are null."""
    text = F.trim(column)
    parsed = F.from_json(F.when(F.startswith(text, F.lit("{")), text), "tier string, reason string, score double, frames int")
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.struct(blank(parsed["tier"]).alias("tier"), blank(parsed["reason"]).alias("reason"), parsed["score"].alias("score"), parsed["frames"].alias("frames"))


def points(polygon: Column, least: int = 3) -> Column:
    """The points as an array of [x, y]; null with fewer than `least`."""
    found = F.from_json(polygon, "points array<array<double>>")["points"]
    return F.when(F.size(found) >= least, found)


def line_ends(polygon: Column, shape: Column) -> Column:
    """The first two points of a line; null for other shapes."""
    return F.when(shape == "line", F.slice(points(polygon, 2), 1, 2))
