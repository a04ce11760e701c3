"""Table scans, versioned snapshots, date-partition upserts, audit appends and object listings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A Parquet table; filters and columns chosen later reach the scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def active_configuration(rules: DataFrame, zones: DataFrame, cameras: DataFrame) -> DataFrame:
    """Enabled rules of each camera, its own and the global ones (no camera), with the rule's active zone if it has one.

    Own and global rules are matched by two equi-joins, never by a disjunction."""
    on = rules.filter("is_enabled").select("rule_id", "rule_type", "zone_id", F.col("camera_id").alias("rule_camera"))
    each = cameras.select("camera_id")
    own = each.join(F.broadcast(on.filter("rule_camera IS NOT NULL")), F.col("camera_id") == F.col("rule_camera"))
    everywhere = each.crossJoin(F.broadcast(on.filter("rule_camera IS NULL")))  # rules are a small configuration table
    active = zones.filter("is_active").select("zone_id", F.col("name").alias("zone_name"))
    return own.union(everywhere).join(F.broadcast(active), "zone_id", "left").select("camera_id", "rule_id", "rule_type", "zone_id", "zone_name")


def list_objects(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, created_at of the files under a folder that Spark can read; contents are not loaded."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("created_at"))


def upsert_by_date(df: DataFrame, path: str, date: str = "summary_date") -> None:
    """Replaces the days that df has and keeps the others."""
    df.write.partitionBy(date).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def append_audit(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_snapshot(df: DataFrame, root: str) -> str:
    """df as a new version under root; a pointer table names it after all of it is written. Earlier versions stay readable."""
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    spark = df.sparkSession
    at = int(spark.range(1).select(F.unix_micros(F.current_timestamp()).alias("t")).first().t)
    spark.range(1).select(F.lit(version).alias("version"), F.lit(at).alias("at")).coalesce(1).write.mode("append").parquet(f"{root}/_pointer.parquet")
    return version


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The version that was written last."""
    pointer = spark.read.parquet(f"{root}/_pointer.parquet")
    version = pointer.agg(F.max_by("version", "at").alias("v")).first().v
    return spark.read.parquet(f"{root}/{version}")
