"""Queries that play a recorded stream through Structured Streaming until all of it is read, and return the table it made."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from storepulse.operators import detections as D
from storepulse.operators import identity as I
from storepulse.plans.lineage import new_path
from storepulse.plans.probes import AS_OF
from storepulse.plans.queries_facts import CROSSINGS, DS, frames
from storepulse.plans.queries_identity import LOW, galleries, probes
from storepulse.plans.registry import SQL, query
from storepulse.sources.streams import detections_stream, end_of_detections, rows_stream, shuffled_arrival, write_in_slices
from storepulse.streaming import identities, late, queues, runs, tracks
from storepulse.thresholds import DEFAULTS


#: Rules that the recorded stream can fire; p.rules has none that it does but restricted zones.
STREAM_RULES = [(10, "line_crossing", 4, 0, 6, None), (11, "zone_dwell", None, None, 30, 4), (12, "billing_interaction", 0, None, 10, 2), (13, "possible_purchase", 1, None, 10, 4), (14, "restricted_zone", 5, 1, 4, None)]


def played(p, slices: int = 3, late_s: float = 9.0, ends: bool = False):
    """Detections as they arrive, up to late_s late, so that slices and batches hold rows out of order. ends: a heartbeat of camera -1 follows."""
    folder = new_path(p.spark, "detections")
    rows = p.detections.withColumn("frame_ts", F.col("frame_ts").cast("timestamp"))
    write_in_slices(rows, folder, shuffled_arrival("frame_ts", F.struct("camera_id", "local_track_id", "frame_ts"), late_s), slices, files=4)
    if ends:
        end_of_detections(p.spark, folder)
    return detections_stream(p.spark, folder, files_per_batch=4)


def events(p):
    rules = p.spark.createDataFrame([(*r, True) for r in STREAM_RULES], "rule_id int, rule_type string, zone_id int, camera_id int, cooldown_seconds int, dwell_threshold_seconds int, is_enabled boolean")
    told = runs.to_table(tracks.track_events(played(p, ends=True), p.zones, tracks.rule_list(rules, p.zones), replace(DEFAULTS, milestones=(2, 4, 8))))
    local = {c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "occurred_at")}
    return told.filter("camera_id >= 0").withColumns(local)


@query("SELECT camera_id, count(*) AS detections, max(frame_ts) AS last FROM detections GROUP BY camera_id")
def s9_detections_stream(p):
    stream = played(p).groupBy("camera_id").agg(F.count("*").alias("detections"), F.max("frame_ts").alias("last"))
    return runs.latest_state(stream, ["camera_id"], "detections").withColumn("last", F.col("last").cast("timestamp_ntz"))


@query(f"WITH {DS} SELECT camera_id, local_track_id, min(frame_ts) AS started_at FROM ds GROUP BY camera_id, local_track_id, session")
def t1_track_lifecycle(p):
    return events(p).filter("event_type = 'person_entered_view'").select("camera_id", "local_track_id", "started_at")


@query(f"WITH {DS} SELECT camera_id, local_track_id, min(frame_ts) AS started_at, max(frame_ts) AS ended_at, count(*) AS total_frames, round(avg(confidence), 6) AS avg_confidence FROM ds GROUP BY camera_id, local_track_id, session")
def t1_session_rows(p):
    return tracks.sessions_of(events(p))


@query(f"""
WITH {DS}, o AS (SELECT *, coalesce(lag(zones) OVER (PARTITION BY camera_id, local_track_id, session ORDER BY frame_ts), []) AS before FROM fr)
SELECT camera_id, local_track_id, frame_ts AS occurred_at, unnest(list_filter(zones, lambda z: NOT list_contains(before, z))) AS zone_id, 'zone_enter' AS event_type FROM o UNION ALL SELECT camera_id, local_track_id, frame_ts, unnest(list_filter(before, lambda z: NOT list_contains(zones, z))), 'zone_exit' FROM o""")
def t2_zone_stream(p):
    return events(p).filter("event_type IN ('zone_enter', 'zone_exit')").select("camera_id", "local_track_id", "occurred_at", "zone_id", "event_type")


@query()
def t2_milestone_stream(p):
    told = events(p).filter("event_type = 'zone_dwell'")
    return told.select("camera_id", "local_track_id", "zone_id", F.col("occurred_at").alias("frame_ts"), F.col("dwell").cast("int").alias("step"))


SQL["t2_milestone_stream"] = f"SELECT camera_id, local_track_id, zone_id, frame_ts, step FROM ({SQL['w7_milestones']})"


@query(f"""
WITH {DS}, crossed AS ({CROSSINGS}),
rl(rule_id, cooldown) AS (VALUES (10, 6), (11, 30), (12, 10), (13, 10), (14, 4)),
zs AS (SELECT DISTINCT camera_id, local_track_id, session, zone_id FROM dw),
ld AS (SELECT f.camera_id, f.local_track_id, f.session, f.frame_ts, zs.zone_id, dw.dwell IS NOT NULL AS inside, last_value(dw.dwell IGNORE NULLS) OVER (PARTITION BY f.camera_id, f.local_track_id, f.session, zs.zone_id ORDER BY f.frame_ts) AS dwell
  FROM fr f JOIN zs ON f.camera_id = zs.camera_id AND f.local_track_id = zs.local_track_id AND f.session = zs.session LEFT JOIN dw ON dw.camera_id = f.camera_id AND dw.local_track_id = f.local_track_id AND dw.session = f.session AND dw.frame_ts = f.frame_ts AND dw.zone_id = zs.zone_id),
cand AS (SELECT camera_id, local_track_id, session, frame_ts, 10 AS rule_id, concat('line_crossing_', direction) AS event_type, NULL::DOUBLE AS dwell FROM crossed WHERE zone_id = 4 AND camera_id = 0
  UNION ALL SELECT camera_id, local_track_id, session, frame_ts, 11, 'zone_dwell_rule', max(dwell) FROM ld GROUP BY ALL HAVING max(dwell) >= 4
  UNION ALL SELECT camera_id, local_track_id, session, frame_ts, 12, 'billing_interaction', dwell FROM ld WHERE inside AND zone_id = 0 AND dwell >= 2
  UNION ALL SELECT camera_id, local_track_id, session, frame_ts, 13, 'possible_purchase', dwell FROM ld WHERE inside AND zone_id = 1 AND dwell >= 4
  UNION ALL SELECT camera_id, local_track_id, session, frame_ts, 14, 'restricted_zone', dwell FROM ld WHERE inside AND zone_id = 5),
o AS (SELECT *, row_number() OVER (PARTITION BY camera_id, local_track_id, session, rule_id ORDER BY frame_ts) AS i FROM cand JOIN rl USING (rule_id)),
k AS (SELECT *, frame_ts AS last, true AS keep FROM o WHERE i = 1 UNION ALL SELECT o.*, CASE WHEN epoch(o.frame_ts - k.last) >= o.cooldown THEN o.frame_ts ELSE k.last END, epoch(o.frame_ts - k.last) >= o.cooldown
  FROM k JOIN o ON o.camera_id = k.camera_id AND o.local_track_id = k.local_track_id AND o.session = k.session AND o.rule_id = k.rule_id AND o.i = k.i + 1)
SELECT camera_id, local_track_id, frame_ts AS occurred_at, rule_id, event_type, dwell FROM k WHERE keep""")
def t3_rule_stream(p):
    return events(p).filter("rule_id IS NOT NULL").select("camera_id", "local_track_id", "occurred_at", "rule_id", "event_type", "dwell")


QUEUES = "z AS (SELECT camera_id, frame_ts, local_track_id, unnest(zones) AS zone_id FROM fr), q AS (SELECT camera_id, frame_ts, zone_id, count(DISTINCT local_track_id) AS tracks FROM z GROUP BY ALL HAVING count(DISTINCT local_track_id) >= 2)"


@query(f"WITH {DS}, {QUEUES} SELECT * FROM q")
def t4_queue_counts(p):
    return D.queue_counts(frames(p), 2)


@query(f"""
WITH {DS}, {QUEUES},
o AS (SELECT camera_id, zone_id, 20 + zone_id AS rule_id, frame_ts, tracks, row_number() OVER (PARTITION BY camera_id, zone_id ORDER BY frame_ts) AS i FROM q WHERE zone_id IN (0, 1, 2)),
k AS (SELECT *, frame_ts AS last, true AS keep FROM o WHERE i = 1 UNION ALL SELECT o.*, CASE WHEN epoch(o.frame_ts - k.last) >= 20 THEN o.frame_ts ELSE k.last END, epoch(o.frame_ts - k.last) >= 20 FROM k JOIN o ON o.camera_id = k.camera_id AND o.zone_id = k.zone_id AND o.i = k.i + 1)
SELECT camera_id, zone_id, rule_id, frame_ts AS occurred_at, CAST(tracks AS INT) AS tracks FROM k WHERE keep""")
def t4_queue_stream(p):
    """Rules 20 to 22 on the zones 0 to 2, from two tracks on; 25 is off, and 24 is another camera's."""
    rules = [(20, 0, None, True), (21, 1, 1, True), (22, 2, None, True), (24, 1, 3, True), (25, 1, None, False)]
    table = p.spark.createDataFrame([(r, "queue_count", z, c, on, 20, 2) for r, z, c, on in rules], "rule_id int, rule_type string, zone_id int, camera_id int, is_enabled boolean, cooldown_seconds int, count_threshold int")
    told = runs.to_table(queues.queue_events(played(p, ends=True), p.zones, table))
    return told.select("camera_id", "zone_id", "rule_id", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"), "tracks")


@query("SELECT DISTINCT event_id // 5 AS session_id, zone_id FROM ev WHERE event_type = 'billing_interaction'")
def t5_one_billing_row(p):
    """Sessions of five events in a row; they last for less than the watermark's day, so the state holds a day's sessions."""
    folder = new_path(p.spark, "billing")
    rows = p.events.filter("event_type = 'billing_interaction'").select(F.expr("event_id DIV 5").alias("session_id"), "zone_id", F.col("occurred_at").cast("timestamp").alias("occurred_at"))
    write_in_slices(rows, folder, "occurred_at", 3, files=4)
    return runs.to_table(tracks.one_per_session_and_zone(rows_stream(p.spark, folder, rows.schema, files_per_batch=4), "occurred_at", "1 day")).select("session_id", "zone_id")


@query("SELECT e.event_id, coalesce(e.person_id, s.person_id) AS person_id FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN person_id END AS person_id, event_id % 700 AS session_id FROM ev) e LEFT JOIN sessions s USING (session_id)")
def t6_late_identity_fill(p):
    """700 sessions, whose persons become known at some time of the month, most of them batches after their first events."""
    rows = p.events.selectExpr("event_id", "CASE WHEN event_id % 3 <> 0 THEN person_id END AS person_id", "event_id % 700 AS session_id", "CAST(occurred_at AS TIMESTAMP) AS occurred_at")
    known = p.sessions.filter("session_id < 700").selectExpr("session_id", "person_id", "TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(CAST(session_id * 7919 % 30 AS INT)) AS resolved_at")
    folders = {}
    for name, df, ts in (("events", rows, "occurred_at"), ("identities", known, "resolved_at")):
        folders[name] = new_path(p.spark, name)
        write_in_slices(df, folders[name], ts, 5, files=4)
    stream = lambda name, df, ts: rows_stream(p.spark, folders[name], df.schema, files_per_batch=4).withWatermark(ts, "10 minutes")
    out = late.late_fill(stream("events", rows, "occurred_at"), stream("identities", known, "resolved_at"), 60 * 86400.0, new_path(p.spark, "filled"), new_path(p.spark, "progress"))
    return out.select("event_id", "person_id")


@query("SELECT camera_id, local_track_id, max(frame_ts) AS last_seen_at, count(*) AS frames FROM detections GROUP BY ALL")
def t9_live_tracks(p):
    out = runs.latest_state(tracks.live_tracks(played(p)), ["camera_id", "local_track_id"], "frames")
    return out.withColumn("last_seen_at", F.col("last_seen_at").cast("timestamp_ntz"))


@query()
def t10_live_matches(p):
    folder = new_path(p.spark, "probes")
    rows = probes(p)
    write_in_slices(rows, folder, "start", 2, files=4)
    f, b = galleries(p)
    out = runs.live_matches(rows_stream(p.spark, folder, rows.schema, files_per_batch=4), lambda batch: I.match_identities(batch, p.persons, f, b, p.sessions, AS_OF, LOW))
    return out.withColumn("score", F.round("score", 5))


SQL["t10_live_matches"] = SQL["i1_match_identities"]


@query()
def t10_growing_galleries(p):
    folder = new_path(p.spark, "windows")
    own = p.faces.select(F.col("face_id").alias("query"), "face_score", "face_crop_path").join(p.bodies.select(F.col("body_id").alias("query"), F.col("crop_quality").alias("quality")), "query")
    rows = probes(p).join(own, "query").withColumn("good_faces", F.lit(2))
    write_in_slices(rows, folder, "start", 2, files=4)
    f, b = galleries(p)
    return identities.live_identities(rows_stream(p.spark, folder, rows.schema, files_per_batch=4), p.persons, f, b, p.sessions, replace(LOW, face_match=0.5, face_recent=0.5, body_match=0.5, body_recent=0.5, face_contamination=0.0, body_contamination=0.0))
