"""Set operations over stored objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.functions.scalars import object_key
from storepulse.operators.scopes import at


def crop_paths(losers: DataFrame, faces: DataFrame, bodies: DataFrame) -> DataFrame:
    """path of all crops of the losers' galleries, repeats included."""
    f = faces.join(losers, "person_id", "left_semi").select(F.col("face_crop_path").alias("path"))
    return f.unionByName(bodies.join(losers, "person_id", "left_semi").select(F.col("crop_path").alias("path"))).filter("path IS NOT NULL")


def referenced_paths(*sources: tuple[DataFrame, str]) -> DataFrame:
    """Distinct non-null paths of several tables."""
    out = None
    for df, column in sources:
        one = df.select(F.col(column).alias("path")).filter("path IS NOT NULL")
        out = one if out is None else out.union(one)
    return out.distinct()


def orphans(listing: DataFrame, referenced: DataFrame, bucket: str = "media") -> DataFrame:
    """Listed paths that no reference has, with or without the bucket's name before it."""
    keys = referenced.select(object_key(F.col("path"), bucket).alias("key")).distinct()
    return listing.select("path").distinct().withColumn("key", object_key(F.col("path"), bucket)).join(keys, "key", "left_anti").select("path")


def expired(objects: DataFrame, as_of, days: int = 30) -> DataFrame:
    return objects.filter(F.col("created_at") < at(as_of) - F.expr(f"INTERVAL '{days}' DAY"))
