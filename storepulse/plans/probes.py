"""The given tables seen as the domain's: sessions, events, billing, persons, galleries, cameras and detections.

Each table is built twice, as DataFrames and as DuckDB common table expressions, from the same arithmetic.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.sources.tables import read_table

AS_OF = "2024-01-25 12:00:00"
START, END = "2024-01-10 00:00:00", "2024-01-17 00:00:00"


def ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


class Probes:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def raw(self) -> DataFrame:
        return self.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))

    @cached_property
    def sessions(self) -> DataFrame:
        return self.raw.selectExpr(
            "event_id AS session_id", "k % 25 AS camera_id", "CAST(event_id % 7 AS INT) AS local_track_id", "CASE WHEN event_id % 7 <> 0 THEN user_id END AS person_id", "ts AS started_at",
            "ts + make_dt_interval(0, 0, 0, CAST(floor(value) AS INT) * 20) AS last_seen_at",
            "CASE WHEN event_id % 11 <> 0 THEN ts + make_dt_interval(0, 0, 0, CAST(floor(value) AS INT) * 20) END AS ended_at", "event_id % 11 = 0 AS is_active", "CAST(floor(value) AS INT) AS total_frames",
            "CASE user_id % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END AS gender", "CASE WHEN event_id % 5 = 0 THEN concat('crops/', event_id) WHEN event_id % 5 = 1 THEN concat('media/crops/', event_id) END AS best_crop_path",
            "CASE event_id % 4 WHEN 0 THEN '[[1, 2, 3, 4]]' WHEN 1 THEN concat('{\"tier\": \"face\", \"score\": ', CAST(floor(value) AS INT), ', \"reason\": \" \", \"frames\": ', k, '}') WHEN 2 THEN '{\"tier\": \" body \"}' END AS debug_json",
        )

    @cached_property
    def cameras(self) -> DataFrame:
        return self.table("nation").selectExpr("n_nationkey AS camera_id", "n_name AS name", "n_regionkey AS store_id", "n_nationkey % 5 <> 0 AS is_active", "CASE WHEN n_nationkey % 3 = 0 THEN 'offline' ELSE 'online' END AS status")

    @cached_property
    def stores(self) -> DataFrame:
        return self.table("region").selectExpr("r_regionkey AS store_id", "r_name AS name")

    @cached_property
    def persons(self) -> DataFrame:
        return self.raw.groupBy("user_id").agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"), F.count("*").alias("visit_count")).selectExpr(
            "user_id AS person_id", "first_seen_at", "last_seen_at", "visit_count", "user_id % 10 = 0 AS is_staff", "CASE user_id % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END AS gender",
            "CASE WHEN user_id % 11 <> 0 THEN CAST((user_id * 7) % 95 AS INT) END AS estimated_age", "CAST((user_id * 37) % 100 AS DOUBLE) / 100 AS best_face_score", "user_id % 4 <> 0 AS has_face", "concat('faces/', user_id) AS face_crop_path",
        )

    @cached_property
    def events(self) -> DataFrame:
        return self.raw.selectExpr(
            "event_id", "k % 25 AS camera_id", "CASE WHEN event_id % 7 <> 0 THEN user_id END AS person_id", "event_id AS session_id", "k % 6 AS zone_id", "k % 3 AS rule_id",
            "CASE event_type WHEN 'click' THEN 'line_crossing_forward' WHEN 'view' THEN 'line_crossing_backward' WHEN 'purchase' THEN 'billing_interaction' WHEN 'signup' THEN 'zone_dwell' ELSE 'zone_exit' END AS event_type",
            "CASE WHEN value > 100 THEN 'High' ELSE 'Low' END AS severity", "CASE WHEN event_id % 6 <> 0 THEN concat('{\"dwell_seconds\": ', CAST(floor(value) AS INT), '}') ELSE '{}' END AS metadata", "ts AS occurred_at", "event_type = 'error' AS is_false_positive", "event_id % 3 = 0 AS is_acknowledged",
        )

    @cached_property
    def billing(self) -> DataFrame:
        return self.raw.filter("event_type = 'purchase'").selectExpr(
            "event_id AS billing_id", "k % 25 AS camera_id", "CASE WHEN event_id % 7 <> 0 AND event_id % 13 <> 0 THEN user_id END AS person_id", "CASE WHEN event_id % 9 <> 0 THEN event_id END AS session_id", "k % 6 AS zone_id",
            "ts AS entered_at", "CASE WHEN event_id % 8 <> 0 THEN ts + make_dt_interval(0, 0, 0, CAST(floor(value) AS INT)) END AS exited_at", "CASE WHEN event_id % 10 <> 0 THEN value END AS dwell_seconds", "CASE WHEN k % 2 = 0 THEN 'counter' ELSE 'queue' END AS interaction_type",
        )

    @cached_property
    def faces(self) -> DataFrame:
        return self.table("embeddings").selectExpr(
            "vec_id AS face_id", "CAST(label * 10 + vec_id % 10 AS BIGINT) AS person_id", "embedding", "CAST(vec_id % 25 AS INT) AS camera_id", "CAST((vec_id * 37) % 100 AS DOUBLE) / 100 AS face_score",
            "CAST('2024-01-20 00:00:00' AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, 0, CAST(vec_id AS INT) * 60) AS captured_at", "concat('faces/', vec_id % 50) AS face_crop_path", "vec_id AS session_id",
        )

    @cached_property
    def bodies(self) -> DataFrame:
        return self.table("embeddings").selectExpr(
            "vec_id AS body_id", "CAST(label * 5 + vec_id % 5 AS BIGINT) AS person_id", "embedding", "CAST(vec_id % 25 AS INT) AS camera_id", "CAST((vec_id * 53) % 100 AS DOUBLE) / 100 AS crop_quality",
            "CAST('2024-01-20 00:00:00' AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, 0, CAST(vec_id AS INT) * 60) AS captured_at", "concat('crops/', vec_id % 50) AS crop_path",
        )

    @cached_property
    def zones(self) -> DataFrame:
        return self.spark.range(6).selectExpr(
            "CAST(id AS INT) AS zone_id", "concat('zone ', id) AS name", "CASE id WHEN 0 THEN 'billing' WHEN 5 THEN 'restricted' ELSE 'general' END AS zone_type", "CASE WHEN id = 4 THEN 'line' ELSE 'polygon' END AS shape", "CAST(id % 4 AS INT) AS camera_id", "id <> 3 AS is_active",
            "CASE id WHEN 0 THEN '{\"points\": [[0, 0], [50, 0], [50, 50], [0, 50]]}' WHEN 1 THEN '{\"points\": [[40, 40], [100, 40], [100, 100], [40, 100]]}' WHEN 2 THEN '{\"points\": [[10, 10], [90, 50], [10, 90]]}' WHEN 3 THEN '{\"points\": [[0, 0], [1, 1]]}' WHEN 4 THEN '{\"points\": [[0, 50], [100, 50]]}' ELSE '{\"points\": [[0, 0], [100, 0], [100, 100], [50, 20], [0, 100]]}' END AS polygon",
        )

    @cached_property
    def rules(self) -> DataFrame:
        return self.spark.range(6).selectExpr(
            "CAST(id AS INT) AS rule_id", "element_at(array('line_crossing', 'zone_dwell', 'billing_interaction', 'possible_purchase', 'restricted_zone', 'queue_count'), CAST(id AS INT) + 1) AS rule_type", "CASE WHEN id <> 1 THEN CAST(id AS INT) END AS zone_id",
            "CASE WHEN id % 2 = 0 THEN CAST(id % 4 AS INT) END AS camera_id", "30 AS cooldown_seconds", "CASE id WHEN 1 THEN 60 WHEN 2 THEN 10 END AS dwell_threshold_seconds", "id <> 5 AS is_enabled",
        )

    @cached_property
    def detections(self) -> DataFrame:
        """A track's rows follow each other by seconds: 200 events share a camera and a track, on a grid of 2 s, with a pause now and then."""
        return self.raw.selectExpr(
            "CAST(event_id % 4 AS INT) AS camera_id", "CAST(event_id % 12 AS INT) AS local_track_id", "event_id AS n",
            "CAST('2024-01-01 10:00:00' AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, 0, CAST((event_id DIV 12) * 2 + (event_id DIV 600) * 20 AS INT)) AS frame_ts",
            "CAST(k * 15 + (event_id % 5) * 20 AS DOUBLE) AS x", "CAST((k * 7 + event_id) % 90 * 10 AS DOUBLE) AS y", "value", "k",
        ).selectExpr("camera_id", "local_track_id", "frame_ts", "named_struct('x1', x, 'y1', y, 'x2', x + 100, 'y2', y + 150) AS bbox", "CAST(k AS DOUBLE) / 100 AS confidence", "1920 AS frame_width", "1080 AS frame_height")

    @cached_property
    def objects(self) -> DataFrame:
        return self.raw.selectExpr("concat(CASE WHEN event_id % 2 = 0 THEN 'media/' ELSE '' END, CASE WHEN k % 2 = 0 THEN 'crops/' ELSE 'faces/' END, event_id % 300) AS path", "CAST(floor(value * 1000) AS BIGINT) AS size", "ts AS created_at", "CASE WHEN k % 3 = 0 THEN 'snapshot' ELSE 'crop' END AS storage_type", "k % 25 AS camera_id")

    @cached_property
    def devices(self) -> DataFrame:
        return self.raw.selectExpr(
            "user_id", "event_id % 50 AS device", "concat('10.0.', k, '.', event_id % 250) AS ip_address",
            "element_at(array('Mozilla/5.0 (Windows NT 10.0) Chrome/120 Safari/537', 'Mozilla/5.0 (X11; Linux; Android 13) Chrome/120 Safari/537', 'Mozilla/5.0 (iPhone; CPU iPhone OS 16) Version/16 Safari/604', 'Mozilla/5.0 (Macintosh; Mac OS X) Firefox/121', 'Mozilla/5.0 (Windows NT) Edg/120 Chrome/120', 'curl/8'), CAST(event_id % 6 AS INT) + 1) AS user_agent",
            "ts AS login_at", "ts + make_dt_interval(0, 0, CAST(floor(value) AS INT), 0) AS last_active_at", "ts + INTERVAL '7' DAY AS expires_at", "event_id % 4 <> 0 AS is_active", "k % 25 AS camera_id", "CASE WHEN event_id % 3 = 0 THEN ts + make_dt_interval(0, 0, CAST(floor(value) AS INT), 30) END AS ended_at",
        )


CTES = """
raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
sessions AS (
  SELECT event_id AS session_id, k % 25 AS camera_id, CAST(event_id % 7 AS INT) AS local_track_id, CASE WHEN event_id % 7 <> 0 THEN user_id END AS person_id, ts AS started_at,
    ts + to_seconds(CAST(floor(value) AS INT) * 20) AS last_seen_at, CASE WHEN event_id % 11 <> 0 THEN ts + to_seconds(CAST(floor(value) AS INT) * 20) END AS ended_at, event_id % 11 = 0 AS is_active, CAST(floor(value) AS INT) AS total_frames,
    CASE user_id % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END AS gender, CASE WHEN event_id % 5 = 0 THEN concat('crops/', event_id) WHEN event_id % 5 = 1 THEN concat('media/crops/', event_id) END AS best_crop_path,
    CASE event_id % 4 WHEN 0 THEN '[[1, 2, 3, 4]]' WHEN 1 THEN concat('{"tier": "face", "score": ', CAST(floor(value) AS INT), ', "reason": " ", "frames": ', k, '}') WHEN 2 THEN '{"tier": " body "}' END AS debug_json
  FROM raw),
cameras AS (SELECT n_nationkey AS camera_id, n_name AS name, n_regionkey AS store_id, n_nationkey % 5 <> 0 AS is_active, CASE WHEN n_nationkey % 3 = 0 THEN 'offline' ELSE 'online' END AS status FROM nation),
stores AS (SELECT r_regionkey AS store_id, r_name AS name FROM region),
persons AS (
  SELECT user_id AS person_id, min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) AS visit_count, user_id % 10 = 0 AS is_staff, CASE user_id % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END AS gender,
    CASE WHEN user_id % 11 <> 0 THEN CAST((user_id * 7) % 95 AS INT) END AS estimated_age, CAST((user_id * 37) % 100 AS DOUBLE) / 100 AS best_face_score, user_id % 4 <> 0 AS has_face, concat('faces/', user_id) AS face_crop_path
  FROM raw GROUP BY user_id),
ev AS (
  SELECT event_id, k % 25 AS camera_id, CASE WHEN event_id % 7 <> 0 THEN user_id END AS person_id, event_id AS session_id, k % 6 AS zone_id, k % 3 AS rule_id,
    CASE event_type WHEN 'click' THEN 'line_crossing_forward' WHEN 'view' THEN 'line_crossing_backward' WHEN 'purchase' THEN 'billing_interaction' WHEN 'signup' THEN 'zone_dwell' ELSE 'zone_exit' END AS event_type,
    CASE WHEN value > 100 THEN 'High' ELSE 'Low' END AS severity, CASE WHEN event_id % 6 <> 0 THEN concat('{"dwell_seconds": ', CAST(floor(value) AS INT), '}') ELSE '{}' END AS metadata, ts AS occurred_at, event_type = 'error' AS is_false_positive, event_id % 3 = 0 AS is_acknowledged
  FROM raw),
billing AS (
  SELECT event_id AS billing_id, k % 25 AS camera_id, CASE WHEN event_id % 7 <> 0 AND event_id % 13 <> 0 THEN user_id END AS person_id, CASE WHEN event_id % 9 <> 0 THEN event_id END AS session_id, k % 6 AS zone_id, ts AS entered_at,
    CASE WHEN event_id % 8 <> 0 THEN ts + to_seconds(CAST(floor(value) AS INT)) END AS exited_at, CASE WHEN event_id % 10 <> 0 THEN value END AS dwell_seconds, CASE WHEN k % 2 = 0 THEN 'counter' ELSE 'queue' END AS interaction_type
  FROM raw WHERE event_type = 'purchase'),
faces AS (
  SELECT vec_id AS face_id, CAST(label * 10 + vec_id % 10 AS BIGINT) AS person_id, embedding::DOUBLE[] AS embedding, CAST(vec_id % 25 AS INT) AS camera_id, CAST((vec_id * 37) % 100 AS DOUBLE) / 100 AS face_score,
    TIMESTAMP '2024-01-20 00:00:00' + to_seconds(CAST(vec_id AS INT) * 60) AS captured_at, concat('faces/', vec_id % 50) AS face_crop_path, vec_id AS session_id
  FROM embeddings),
bodies AS (
  SELECT vec_id AS body_id, CAST(label * 5 + vec_id % 5 AS BIGINT) AS person_id, embedding::DOUBLE[] AS embedding, CAST(vec_id % 25 AS INT) AS camera_id, CAST((vec_id * 53) % 100 AS DOUBLE) / 100 AS crop_quality,
    TIMESTAMP '2024-01-20 00:00:00' + to_seconds(CAST(vec_id AS INT) * 60) AS captured_at, concat('crops/', vec_id % 50) AS crop_path
  FROM embeddings),
zones AS (
  SELECT CAST(id AS INT) AS zone_id, concat('zone ', id) AS name, CASE id WHEN 0 THEN 'billing' WHEN 5 THEN 'restricted' ELSE 'general' END AS zone_type, CASE WHEN id = 4 THEN 'line' ELSE 'polygon' END AS shape, CAST(id % 4 AS INT) AS camera_id, id <> 3 AS is_active,
    CASE id WHEN 0 THEN '{"points": [[0, 0], [50, 0], [50, 50], [0, 50]]}' WHEN 1 THEN '{"points": [[40, 40], [100, 40], [100, 100], [40, 100]]}' WHEN 2 THEN '{"points": [[10, 10], [90, 50], [10, 90]]}' WHEN 3 THEN '{"points": [[0, 0], [1, 1]]}' WHEN 4 THEN '{"points": [[0, 50], [100, 50]]}' ELSE '{"points": [[0, 0], [100, 0], [100, 100], [50, 20], [0, 100]]}' END AS polygon
  FROM range(6) t(id)),
rules AS (
  SELECT CAST(id AS INT) AS rule_id, ['line_crossing', 'zone_dwell', 'billing_interaction', 'possible_purchase', 'restricted_zone', 'queue_count'][id + 1] AS rule_type, CASE WHEN id <> 1 THEN CAST(id AS INT) END AS zone_id,
    CASE WHEN id % 2 = 0 THEN CAST(id % 4 AS INT) END AS camera_id, 30 AS cooldown_seconds, CASE id WHEN 1 THEN 60 WHEN 2 THEN 10 END AS dwell_threshold_seconds, id <> 5 AS is_enabled
  FROM range(6) t(id)),
detections AS (
  SELECT CAST(event_id % 4 AS INT) AS camera_id, CAST(event_id % 12 AS INT) AS local_track_id, TIMESTAMP '2024-01-01 10:00:00' + to_seconds(CAST((event_id // 12) * 2 + (event_id // 600) * 20 AS INT)) AS frame_ts,
    CAST(k * 15 + (event_id % 5) * 20 AS DOUBLE) AS x1, CAST((k * 7 + event_id) % 90 * 10 AS DOUBLE) AS y1, CAST(k * 15 + (event_id % 5) * 20 AS DOUBLE) + 100 AS x2, CAST((k * 7 + event_id) % 90 * 10 AS DOUBLE) + 150 AS y2, CAST(k AS DOUBLE) / 100 AS confidence, 1920 AS frame_width, 1080 AS frame_height
  FROM raw),
objects AS (SELECT concat(CASE WHEN event_id % 2 = 0 THEN 'media/' ELSE '' END, CASE WHEN k % 2 = 0 THEN 'crops/' ELSE 'faces/' END, event_id % 300) AS path, CAST(floor(value * 1000) AS BIGINT) AS size, ts AS created_at, CASE WHEN k % 3 = 0 THEN 'snapshot' ELSE 'crop' END AS storage_type, k % 25 AS camera_id FROM raw),
devices AS (
  SELECT user_id, event_id % 50 AS device, concat('10.0.', k, '.', event_id % 250) AS ip_address,
    ['Mozilla/5.0 (Windows NT 10.0) Chrome/120 Safari/537', 'Mozilla/5.0 (X11; Linux; Android 13) Chrome/120 Safari/537', 'Mozilla/5.0 (iPhone; CPU iPhone OS 16) Version/16 Safari/604', 'Mozilla/5.0 (Macintosh; Mac OS X) Firefox/121', 'Mozilla/5.0 (Windows NT) Edg/120 Chrome/120', 'curl/8'][event_id % 6 + 1] AS user_agent,
    ts AS login_at, ts + to_minutes(CAST(floor(value) AS INT)) AS last_active_at, ts + INTERVAL 7 DAY AS expires_at, event_id % 4 <> 0 AS is_active, k % 25 AS camera_id, CASE WHEN event_id % 3 = 0 THEN ts + to_minutes(CAST(floor(value) AS INT)) + to_seconds(30) END AS ended_at
  FROM raw)
"""
