"""Queries: joins, windows, sets, detections and repair of visits."""

from __future__ import annotations

from pyspark.sql import functions as F

from storepulse.operators import detections as D
from storepulse.operators import intervals as I
from storepulse.operators import repair as B
from storepulse.operators import sets as U
from storepulse.operators import spacing
from storepulse.operators import windows as X
from storepulse.plans.lineage import cut
from storepulse.plans.probes import AS_OF, END, START
from storepulse.plans.registry import query
from storepulse.thresholds import DEFAULTS

W = f"BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"


@query("SELECT session_id, c.name AS camera, s.name AS store, p.visit_count FROM sessions JOIN cameras c USING (camera_id) JOIN stores s USING (store_id) LEFT JOIN persons p USING (person_id)")
def j1_dimensions(p):
    c = p.cameras.select("camera_id", F.col("name").alias("camera"), "store_id")
    s = p.stores.select("store_id", F.col("name").alias("store"))
    return p.sessions.join(F.broadcast(c), "camera_id").join(F.broadcast(s), "store_id").join(p.persons.select("person_id", "visit_count"), "person_id", "left").select("session_id", "camera", "store", "visit_count")


@query("SELECT person_id FROM persons WHERE has_face AND EXISTS (SELECT 1 FROM billing b WHERE b.person_id = persons.person_id)")
def j2_semi(p):
    return p.persons.filter("has_face").join(p.billing.select("person_id"), "person_id", "left_semi").select("person_id")


@query("SELECT person_id FROM persons WHERE NOT EXISTS (SELECT 1 FROM billing b WHERE b.person_id = persons.person_id AND b.zone_id = 0)")
def j3_anti(p):
    return p.persons.join(p.billing.filter("zone_id = 0").select("person_id"), "person_id", "left_anti").select("person_id")


@query("SELECT billing_id, coalesce(b.person_id, s.person_id) AS person_id, b.camera_id FROM billing b LEFT JOIN sessions s USING (session_id)")
def j4_update_from(p):
    return B.fill_null_persons(p.billing, p.sessions).select("billing_id", "person_id", "camera_id")


SESS = "(SELECT session_id, camera_id, person_id, started_at AS s, coalesce(ended_at, last_seen_at) AS e FROM sessions)"


@query(f"SELECT a.session_id AS a, b.session_id AS b, a.camera_id, epoch(least(a.e, b.e) - greatest(a.s, b.s))::DOUBLE AS overlap FROM {SESS} a JOIN {SESS} b ON a.camera_id = b.camera_id AND a.person_id = b.person_id AND a.session_id < b.session_id WHERE epoch(least(a.e, b.e) - greatest(a.s, b.s)) >= 10")
def j5_same_camera_overlap(p):
    return I.overlapping_sessions(p.sessions).select("a", "b", "camera_id", "overlap")


@query(f"SELECT a.person_id AS person_a, b.person_id AS person_b, count(*) AS overlaps FROM {SESS} a JOIN {SESS} b ON a.person_id < b.person_id AND a.camera_id <> b.camera_id AND a.s < b.e AND b.s < a.e GROUP BY 1, 2")
def j6_concurrent_persons(p):
    return I.concurrent_persons(p.sessions)


@query(f"SELECT a.session_id AS a, b.session_id AS b, CASE WHEN greatest(epoch(b.s - a.e), epoch(a.s - b.e)) >= 0 THEN greatest(epoch(b.s - a.e), epoch(a.s - b.e))::DOUBLE END AS gap FROM {SESS} a JOIN {SESS} b ON a.camera_id = b.camera_id AND a.session_id < b.session_id AND greatest(epoch(b.s - a.e), epoch(a.s - b.e)) <= 60")
def j7_neighbouring_sessions(p):
    return I.neighbouring_sessions(p.sessions)


@query("SELECT s.session_id, arg_min(f.face_id, {'t': f.captured_at, 'i': f.face_id}) AS face_id, count(*) AS points FROM sessions s JOIN faces f ON s.camera_id = f.camera_id AND f.captured_at BETWEEN s.started_at AND coalesce(s.ended_at, s.last_seen_at) GROUP BY s.session_id")
def j8_point_in_session(p):
    return I.points_in_sessions(p.faces, p.sessions, "face_id", "captured_at")


@query("""
SELECT c.camera_id, c.name, z.zone_id, r.rule_id FROM cameras c LEFT JOIN (SELECT * FROM zones WHERE zone_type = 'billing' AND is_active) z USING (camera_id) LEFT JOIN (SELECT * FROM rules WHERE rule_type = 'billing_interaction' AND is_enabled) r USING (camera_id)""")
def j12_setup_audit(p):
    z = p.zones.filter("zone_type = 'billing' AND is_active").select("camera_id", "zone_id")
    r = p.rules.filter("rule_type = 'billing_interaction' AND is_enabled").select("camera_id", "rule_id")
    return p.cameras.select("camera_id", "name").join(F.broadcast(z), "camera_id", "left").join(F.broadcast(r), "camera_id", "left")


@query(f"""
SELECT session_id, camera_id, person_id FROM {SESS} s WHERE NOT EXISTS (SELECT 1 FROM billing b WHERE b.session_id = s.session_id)
AND NOT EXISTS (SELECT 1 FROM billing b WHERE b.camera_id = s.camera_id AND b.person_id = s.person_id AND b.entered_at BETWEEN s.s - INTERVAL 30 SECOND AND s.e + INTERVAL 30 SECOND)""")
def j13_unbilled(p):
    return I.unbilled(p.sessions, p.billing).select("session_id", "camera_id", "person_id")


@query("SELECT * FROM (SELECT face_id, person_id, CAST(row_number() OVER (PARTITION BY person_id ORDER BY face_score DESC, captured_at DESC, face_id DESC) AS INT) AS rank FROM faces) WHERE rank <= 5")
def w1_best_faces(p):
    return X.best_per_person(p.faces, "face_id", "face_score", DEFAULTS.most_faces).select("face_id", "person_id", "rank")


@query("SELECT * FROM (SELECT body_id, person_id, CAST(row_number() OVER (PARTITION BY person_id ORDER BY crop_quality DESC, captured_at DESC, body_id DESC) AS INT) AS rank FROM bodies) WHERE rank <= 10")
def w1_best_bodies(p):
    return X.best_per_person(p.bodies, "body_id", "crop_quality", DEFAULTS.most_bodies).select("body_id", "person_id", "rank")


VISITS = f"""
o AS (SELECT *, lag(e) OVER w AS pe FROM {SESS} WHERE person_id IS NOT NULL WINDOW w AS (PARTITION BY person_id, camera_id ORDER BY s, session_id)),
v AS (SELECT *, CAST(sum(CASE WHEN pe IS NULL OR s < pe OR epoch(s - pe) > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY person_id, camera_id ORDER BY s, session_id) AS BIGINT) AS visit FROM o)"""


@query(f"WITH {VISITS} SELECT session_id, person_id, camera_id, visit FROM v")
def w2_visits(p):
    return X.visits(I.spans(p.sessions).filter("person_id IS NOT NULL"), 3600.0).select("session_id", "person_id", "camera_id", "visit")


@query("""
WITH d AS (SELECT DISTINCT person_id, CAST(started_at + INTERVAL 330 MINUTE AS DATE) - DATE '2000-01-01' AS n FROM sessions WHERE person_id IS NOT NULL),
i AS (SELECT person_id, n - row_number() OVER (PARTITION BY person_id ORDER BY n) AS g FROM d),
c AS (SELECT person_id, count(*) OVER (PARTITION BY person_id ORDER BY n RANGE BETWEEN CURRENT ROW AND 14 FOLLOWING) AS c FROM d)
SELECT person_id FROM persons WHERE has_face AND (person_id IN (SELECT person_id FROM i GROUP BY person_id, g HAVING count(*) >= 5) OR person_id IN (SELECT person_id FROM c WHERE c >= 11))""")
def w3_staff_rule(p):
    return X.staff_rule(p.sessions, p.persons)


DS = """
ds AS (SELECT *, CAST(sum(CASE WHEN silent > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id, local_track_id ORDER BY frame_ts) AS BIGINT) AS session FROM (SELECT *, epoch(frame_ts - lag(frame_ts) OVER (PARTITION BY camera_id, local_track_id ORDER BY frame_ts)) AS silent FROM detections)),
poly AS (SELECT zone_id, camera_id, CAST(json_extract(polygon, '$.points') AS DOUBLE[][]) AS pts FROM zones WHERE shape = 'polygon' AND is_active AND json_array_length(polygon, '$.points') >= 3),
edge AS (SELECT zone_id, camera_id, pts[i][1] AS ax, pts[i][2] AS ay, pts[i % len(pts) + 1][1] AS bx, pts[i % len(pts) + 1][2] AS b_y FROM poly, range(1, 10) t(i) WHERE i <= len(pts)),
pt AS (SELECT camera_id, local_track_id, frame_ts, (x1 + x2) / 2 / frame_width * 100 AS x, y2 / frame_height * 100 AS y FROM ds UNION ALL SELECT camera_id, local_track_id, frame_ts, (x1 + x2) / 2 / frame_width * 100, (y1 + y2) / 2 / frame_height * 100 FROM ds),
hit AS (SELECT DISTINCT camera_id, local_track_id, frame_ts, zone_id FROM (
  SELECT p.*, zone_id, count(*) FILTER (WHERE (ay > y) <> (b_y > y) AND CASE WHEN b_y > ay THEN (x - ax) * (b_y - ay) - (y - ay) * (bx - ax) < 0 ELSE (x - ax) * (b_y - ay) - (y - ay) * (bx - ax) > 0 END) AS odd,
    count(*) FILTER (WHERE (bx - ax) * (y - ay) - (b_y - ay) * (x - ax) = 0 AND x BETWEEN least(ax, bx) AND greatest(ax, bx) AND y BETWEEN least(ay, b_y) AND greatest(ay, b_y)) AS edge
  FROM pt p JOIN edge USING (camera_id) GROUP BY ALL) WHERE odd % 2 = 1 AND edge = 0),
fr AS (SELECT ds.camera_id, ds.local_track_id, session, frame_ts, coalesce(z, []) AS zones, CAST(row_number() OVER (PARTITION BY ds.camera_id, ds.local_track_id, session ORDER BY frame_ts) AS INT) AS n FROM ds LEFT JOIN (SELECT camera_id, local_track_id, frame_ts, list(zone_id ORDER BY zone_id) AS z FROM hit GROUP BY ALL) h USING (camera_id, local_track_id, frame_ts)),
inz AS (SELECT camera_id, local_track_id, session, frame_ts, n, unnest(zones) AS zone_id FROM fr),
stay AS (SELECT *, n - row_number() OVER (PARTITION BY camera_id, local_track_id, session, zone_id ORDER BY n) AS stay FROM inz),
dw AS (SELECT *, epoch(frame_ts - min(frame_ts) OVER (PARTITION BY camera_id, local_track_id, session, zone_id, stay))::DOUBLE AS dwell FROM stay)"""


@query(f"WITH {DS} SELECT camera_id, local_track_id, session, min(frame_ts) AS started_at, max(frame_ts) AS last_seen_at, count(*) AS total_frames, round(avg(confidence), 6) AS avg_confidence FROM ds GROUP BY ALL")
def w4_track_sessions(p):
    return X.track_sessions(p.detections)


def frames(p):
    return D.zone_membership(X.sessionise(p.detections), p.zones)


@query(f"WITH {DS} SELECT camera_id, local_track_id, session, frame_ts, array_to_string(zones, ',') AS zones FROM fr")
def g2_g4_zone_membership(p):
    return frames(p).select("camera_id", "local_track_id", "session", "frame_ts", F.array_join(F.transform("zones", lambda z: z.cast("string")), ",").alias("zones"))


@query(f"""
WITH {DS}, o AS (SELECT *, coalesce(lag(zones) OVER (PARTITION BY camera_id, local_track_id, session ORDER BY frame_ts), []) AS before FROM fr)
SELECT camera_id, local_track_id, session, frame_ts, unnest(list_filter(zones, lambda z: NOT list_contains(before, z))) AS zone_id, 'zone_enter' AS event_type FROM o UNION ALL SELECT camera_id, local_track_id, session, frame_ts, unnest(list_filter(before, lambda z: NOT list_contains(zones, z))), 'zone_exit' FROM o""")
def w5_zone_transitions(p):
    return X.zone_transitions(frames(p))


@query(f"WITH {DS} SELECT camera_id, local_track_id, session, frame_ts, zone_id, dwell FROM dw")
def w6_zone_dwell(p):
    return X.zone_dwell(frames(p)).select("camera_id", "local_track_id", "session", "frame_ts", "zone_id", "dwell")


@query(f"""
WITH {DS}, f AS (SELECT *, row_number() OVER (PARTITION BY camera_id, local_track_id, session, zone_id, stay ORDER BY frame_ts) AS i FROM dw),
t AS (
  SELECT camera_id, local_track_id, session, zone_id, stay, i, frame_ts, CASE WHEN dwell >= 8 THEN 8 WHEN dwell >= 4 THEN 4 WHEN dwell >= 2 THEN 2 END AS step, list_filter([CASE WHEN dwell >= 8 THEN 8 WHEN dwell >= 4 THEN 4 WHEN dwell >= 2 THEN 2 END], lambda s: s IS NOT NULL) AS fired FROM f WHERE i = 1
  UNION ALL
  SELECT f.camera_id, f.local_track_id, f.session, f.zone_id, f.stay, f.i, f.frame_ts, CASE WHEN dwell >= 8 AND NOT list_contains(fired, 8) THEN 8 WHEN dwell >= 4 AND NOT list_contains(fired, 4) THEN 4 WHEN dwell >= 2 AND NOT list_contains(fired, 2) THEN 2 END,
    list_concat(fired, list_filter([CASE WHEN dwell >= 8 AND NOT list_contains(fired, 8) THEN 8 WHEN dwell >= 4 AND NOT list_contains(fired, 4) THEN 4 WHEN dwell >= 2 AND NOT list_contains(fired, 2) THEN 2 END], lambda s: s IS NOT NULL))
  FROM t JOIN f ON f.camera_id = t.camera_id AND f.local_track_id = t.local_track_id AND f.session = t.session AND f.zone_id = t.zone_id AND f.stay = t.stay AND f.i = t.i + 1)
SELECT camera_id, local_track_id, session, zone_id, frame_ts, step FROM t WHERE step IS NOT NULL""")
def w7_milestones(p):
    return X.milestones(X.zone_dwell(frames(p)), (2, 4, 8)).select("camera_id", "local_track_id", "session", "zone_id", "frame_ts", "step")


@query("""
WITH o AS (SELECT camera_id, rule_id, event_id, occurred_at AS t, row_number() OVER (PARTITION BY camera_id, rule_id ORDER BY occurred_at, event_id) AS i FROM ev),
k AS (SELECT camera_id, rule_id, event_id, t, i, t AS last, true AS keep FROM o WHERE i = 1 UNION ALL SELECT o.camera_id, o.rule_id, o.event_id, o.t, o.i, CASE WHEN epoch(o.t - k.last) >= 7200 THEN o.t ELSE k.last END, epoch(o.t - k.last) >= 7200 FROM k JOIN o ON o.camera_id = k.camera_id AND o.rule_id = k.rule_id AND o.i = k.i + 1)
SELECT camera_id, rule_id, event_id FROM k WHERE keep""")
def w8_cooldown(p):
    return spacing.spaced(p.events.select("camera_id", "rule_id", "event_id", "occurred_at"), ["camera_id", "rule_id"], "occurred_at", 7200).drop("occurred_at")


@query(f"""
WITH {DS}, m AS (SELECT camera_id, local_track_id, session, frame_ts, row_number() OVER w AS n, epoch(frame_ts - min(frame_ts) OVER w) AS age,
  max((x1 + x2) / 2) OVER t - min((x1 + x2) / 2) OVER t + max((y1 + y2) / 2) OVER t - min((y1 + y2) / 2) OVER t AS spread FROM ds WINDOW w AS (PARTITION BY camera_id, local_track_id, session ORDER BY frame_ts), t AS (PARTITION BY camera_id, local_track_id, session ORDER BY frame_ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT camera_id, local_track_id, session, frame_ts, round(CASE WHEN n < 3 THEN 0.0::DOUBLE ELSE 0.7::DOUBLE * greatest(0.0::DOUBLE, 1 - spread / 400.0::DOUBLE) + 0.3::DOUBLE * least(1.0::DOUBLE, age / 3.0::DOUBLE) END, 6) AS stability FROM m""")
def w9_stability(p):
    return X.stability(X.sessionise(p.detections))


@query(f"""
WITH {DS}, g AS (SELECT *, (row_number() OVER (PARTITION BY camera_id, local_track_id ORDER BY frame_ts) - 1) // 5 AS win FROM detections)
SELECT camera_id, local_track_id, CAST(win AS BIGINT) AS "window", arg_max(frame_ts, {{'c': confidence, 't': -epoch(frame_ts)}}) AS best_ts, max(confidence) AS best_score FROM g GROUP BY ALL HAVING count(*) = 5""")
def w10_best_of_windows(p):
    return X.best_of_windows(p.detections, ("camera_id", "local_track_id"), "confidence")


BOX = "SELECT camera_id, frame_ts, local_track_id, x1, y1, x2, y2 FROM detections"
IOU = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"


@query(f"""
WITH p AS (SELECT a.camera_id, a.frame_ts, a.local_track_id AS a, b.local_track_id AS b, {IOU} / (15000.0::DOUBLE * 2 - {IOU}) AS iou FROM ({BOX}) a JOIN ({BOX}) b ON a.camera_id = b.camera_id AND a.frame_ts = b.frame_ts AND a.local_track_id < b.local_track_id)
SELECT camera_id, frame_ts, a, b, round(iou, 6) AS iou FROM p WHERE iou > 0""")
def g1_box_overlaps(p):
    return D.box_overlaps(p.detections).filter("iou > 0").withColumn("iou", F.round("iou", 6))


@query(f"""
WITH p AS (SELECT a.camera_id, a.frame_ts, a.local_track_id AS a, b.local_track_id AS b FROM ({BOX}) a JOIN ({BOX}) b ON a.camera_id = b.camera_id AND a.frame_ts = b.frame_ts AND a.local_track_id < b.local_track_id WHERE {IOU} / (15000.0::DOUBLE * 2 - {IOU}) >= 0.1)
SELECT d.camera_id, d.frame_ts, d.local_track_id, EXISTS (SELECT 1 FROM p WHERE p.camera_id = d.camera_id AND p.frame_ts = d.frame_ts AND d.local_track_id IN (p.a, p.b)) AS occluded FROM detections d""")
def g5_occlusion(p):
    return D.occlusion(p.detections).select("camera_id", "frame_ts", "local_track_id", "occluded")


CROSSINGS = """
WITH s AS (SELECT camera_id, local_track_id, session, frame_ts, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM (SELECT *, (x1 + x2) / 2 / frame_width * 100 AS x, (y1 + y2) / 2 / frame_height * 100 AS y FROM ds) WINDOW w AS (PARTITION BY camera_id, local_track_id, session ORDER BY frame_ts)),
l AS (SELECT *, sign(100.0 * (py - 50)) AS a, sign(100.0 * (y - 50)) AS b, sign((x - px) * (50 - py) - (y - py) * (0 - px)) AS c, sign((x - px) * (50 - py) - (y - py) * (100 - px)) AS d FROM s WHERE camera_id = 0 AND px IS NOT NULL)
SELECT camera_id, local_track_id, session, frame_ts, 4 AS zone_id, CASE WHEN y > py THEN 'forward' ELSE 'backward' END AS direction FROM l WHERE a * b <= 0 AND c * d <= 0 AND y <> py"""


@query(f"WITH {DS}, crossed AS ({CROSSINGS}) SELECT * FROM crossed")
def g3_line_crossings(p):
    return D.line_crossings(X.sessionise(p.detections), p.zones).select("camera_id", "local_track_id", "session", "frame_ts", "zone_id", "direction")


FACES_IN_BODIES = """
SELECT f.camera_id, f.frame_ts, f.face, d.local_track_id AS track, f.confidence * (0.5::DOUBLE * least(1.0::DOUBLE, 2000.0::DOUBLE / 450.0::DOUBLE) + 0.5::DOUBLE * greatest(0.0::DOUBLE, 1 - abs((f.x1 + f.x2) / 2 - (d.x1 + d.x2) / 2) / 50.0::DOUBLE)) AS score
FROM (SELECT camera_id, frame_ts, local_track_id AS face, x1 + 30 AS x1, y1 + 10 AS y1, x1 + 70 AS x2, y1 + 60 AS y2, confidence FROM detections) f
JOIN detections d ON d.camera_id = f.camera_id AND d.frame_ts = f.frame_ts AND (f.x1 + f.x2) / 2 BETWEEN d.x1 AND d.x2 AND (f.y1 + f.y2) / 2 BETWEEN d.y1 AND d.y2
WHERE ((f.y1 + f.y2) / 2 - d.y1) / 150 <= 0.7 AND greatest(0, least(f.x2, d.x2) - greatest(f.x1, d.x1)) * greatest(0, least(f.y2, d.y2) - greatest(f.y1, d.y1)) / 2000 >= 0.7"""


@query(f"WITH c AS ({FACES_IN_BODIES}) SELECT * REPLACE (round(score, 6) AS score) FROM c")
def j11_faces_in_bodies(p):
    return D.face_candidates(D.probe_faces(p.detections), p.detections, least_score=0.0).select("camera_id", "frame_ts", "face", "track", F.round("score", 6).alias("score"))


@query(f"""
WITH c AS (SELECT * FROM ({FACES_IN_BODIES}) WHERE score >= 0.45),
w AS (SELECT *, row_number() OVER v AS rk, lead(score) OVER v AS second FROM c WINDOW v AS (PARTITION BY camera_id, frame_ts, face ORDER BY score DESC, track)),
o AS (SELECT c.*, row_number() OVER (PARTITION BY camera_id, frame_ts ORDER BY score DESC, face, track) AS i FROM c SEMI JOIN (SELECT * FROM w WHERE rk = 1 AND (second IS NULL OR second / score < 0.85)) USING (camera_id, frame_ts, face)),
k AS (SELECT *, [face] AS fs, [track] AS ts, true AS keep FROM o WHERE i = 1 UNION ALL
  SELECT o.*, CASE WHEN NOT list_contains(fs, o.face) AND NOT list_contains(ts, o.track) THEN list_append(fs, o.face) ELSE fs END, CASE WHEN NOT list_contains(fs, o.face) AND NOT list_contains(ts, o.track) THEN list_append(ts, o.track) ELSE ts END, NOT list_contains(fs, o.face) AND NOT list_contains(ts, o.track)
  FROM k JOIN o ON o.camera_id = k.camera_id AND o.frame_ts = k.frame_ts AND o.i = k.i + 1)
SELECT camera_id, frame_ts, face, track, round(score, 6) AS score FROM k WHERE keep""")
def i15_face_assignment(p):
    return D.assign_faces(D.face_candidates(D.probe_faces(p.detections), p.detections)).withColumn("score", F.round("score", 6))


@query("SELECT face_crop_path AS path, count(*) AS n FROM (SELECT face_crop_path FROM faces WHERE person_id % 3 = 0 UNION ALL SELECT crop_path FROM bodies WHERE person_id % 3 = 0) GROUP BY 1")
def u1_crop_paths(p):
    losers = p.faces.select("person_id").union(p.bodies.select("person_id")).filter("person_id % 3 = 0").distinct()
    return U.crop_paths(losers, p.faces, p.bodies).groupBy("path").agg(F.count("*").alias("n"))


REFERENCED = "SELECT face_crop_path AS path FROM faces UNION SELECT crop_path FROM bodies UNION SELECT best_crop_path FROM sessions WHERE best_crop_path IS NOT NULL UNION SELECT face_crop_path FROM persons UNION SELECT 'crops/' || zone_id FROM zones"


def referenced(p):
    return U.referenced_paths((p.faces, "face_crop_path"), (p.bodies, "crop_path"), (p.sessions, "best_crop_path"), (p.persons, "face_crop_path"), (p.zones.selectExpr("concat('crops/', zone_id) AS path"), "path"))


@query(REFERENCED)
def u2_referenced_paths(p):
    return referenced(p)


@query(f"WITH r AS ({REFERENCED}) SELECT DISTINCT path FROM objects WHERE replace(path, 'media/', '') NOT IN (SELECT replace(path, 'media/', '') FROM r)")
def u3_orphans(p):
    return U.orphans(p.objects, referenced(p))


@query(f"SELECT path, size, created_at FROM objects WHERE created_at < TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY")
def u4_retention(p):
    return U.expired(p.objects, AS_OF, 10).select("path", "size", "created_at")


@query("SELECT event_id, list_filter([k % 3, k % 5, k % 7], lambda x: NOT list_contains([0, 1, 2], x)) IS NOT NULL AS ok, len(list_distinct(list_filter([k % 3, k % 5, k % 7], lambda x: NOT list_contains([0, 1, 2], x)))) AS n FROM raw")
def u5_set_difference(p):
    diff = F.array_except(F.expr("array(k % 3, k % 5, k % 7)"), F.expr("array(0, 1, 2)"))
    return p.raw.select("event_id", diff.isNotNull().alias("ok"), F.size(diff).cast("long").alias("n"))


@query(f"SELECT session_id, CASE WHEN is_active AND last_seen_at < TIMESTAMP '{AS_OF}' - INTERVAL 10 MINUTE THEN last_seen_at ELSE ended_at END AS ended_at, is_active AND NOT last_seen_at < TIMESTAMP '{AS_OF}' - INTERVAL 10 MINUTE AS is_active FROM sessions")
def t7_close_stale_sessions(p):
    return D.close_stale_sessions(p.sessions, AS_OF).select("session_id", "ended_at", "is_active")


@query(f"SELECT device, user_id, login_at, is_active AND NOT (expires_at <= TIMESTAMP '{AS_OF}' OR last_active_at < TIMESTAMP '{AS_OF}' - INTERVAL 1800 SECOND) AS is_active FROM devices")
def t8_close_stale_devices(p):
    return D.close_stale_devices(p.devices, AS_OF).select("device", "user_id", "login_at", "is_active")


@query(f"SELECT device, user_id, login_at, CASE WHEN ended_at IS NULL AND last_active_at < TIMESTAMP '{AS_OF}' - INTERVAL 7200 SECOND THEN last_active_at ELSE ended_at END AS ended_at FROM devices")
def t8_close_stale_viewers(p):
    return D.close_stale_viewers(p.devices, AS_OF).select("device", "user_id", "login_at", "ended_at")


@query("SELECT user_id, device, count(*) AS logins, min(login_at) AS login_at, max(last_active_at) AS last_active_at, arg_max(ip_address, {'t': last_active_at, 'i': ip_address}) AS ip_address FROM devices GROUP BY user_id, device")
def t11_device_fold_up(p):
    return D.fold_devices(p.devices)


@query(f"SELECT billing_id, CASE WHEN b.person_id IS NULL AND entered_at >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR THEN s.person_id ELSE b.person_id END AS person_id FROM billing b LEFT JOIN sessions s USING (session_id)")
def b1_null_person_fill(p):
    return B.fill_null_persons(p.billing, p.sessions, "entered_at", AS_OF, 48).select("billing_id", "person_id")


@query("SELECT count(*) FILTER (WHERE b.person_id IS NULL) AS without_person, count(*) FILTER (WHERE b.person_id IS NULL AND s.person_id IS NOT NULL) AS would_gain FROM billing b LEFT JOIN sessions s USING (session_id)")
def b1_dry_run(p):
    return B.fill_counts(p.billing, p.sessions)


DW = "zd AS (SELECT session_id, zone_id, max(d) AS dwell FROM (SELECT session_id, zone_id, CAST(json_extract_string(metadata, '$.dwell_seconds') AS DOUBLE) AS d FROM ev WHERE event_type IN ('zone_dwell', 'zone_exit', 'billing_interaction', 'possible_purchase')) WHERE d IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {DW} SELECT * FROM zd")
def b2_zone_dwell(p):
    return B.zone_dwell_by_session(p.events)


def staff(p):
    return p.persons.filter("is_staff").select("person_id")


@query(f"""
WITH g AS (SELECT a.session_id AS orphan, b.session_id AS neighbour, b.person_id, greatest(epoch(b.s - a.e), epoch(a.s - b.e))::DOUBLE AS gap FROM {SESS} a JOIN {SESS} b ON a.camera_id = b.camera_id AND a.person_id IS NULL AND b.person_id IS NOT NULL AND b.person_id NOT IN (SELECT person_id FROM persons WHERE is_staff))
SELECT * FROM g WHERE gap BETWEEN 0 AND 300""")
def b3_stitch_candidates(p):
    return B.stitch_candidates(p.sessions, staff(p), 300.0)


VISIT_ROWS = f"""
{DW}, o AS (SELECT session_id, camera_id, person_id, s, e, zone_id, dwell, lag(e) OVER (PARTITION BY person_id, camera_id, zone_id ORDER BY s, session_id) AS pe FROM {SESS} JOIN zd USING (session_id) WHERE person_id IS NOT NULL),
vs AS (SELECT *, CAST(sum(CASE WHEN pe IS NULL OR s < pe OR epoch(s - pe) > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY person_id, camera_id, zone_id ORDER BY s, session_id) AS BIGINT) AS visit FROM o),
rv AS (SELECT person_id, camera_id, zone_id, visit, min(s) AS entered_at, max(e) AS exited_at, sum(dwell) AS dwell, count(*) AS n, arg_max(session_id, {{'d': dwell, 't': -epoch(s), 'i': -session_id}}) AS session_id FROM vs GROUP BY ALL HAVING sum(dwell) >= 20),
rp AS (SELECT * FROM rv WHERE person_id NOT IN (SELECT person_id FROM persons WHERE is_staff))"""


@query(f"WITH {VISIT_ROWS} SELECT * FROM rp")
def b5_repaired_visits(p):
    return B.repaired_visits(p.sessions, B.zone_dwell_by_session(p.events), staff(p)).drop("sessions")


def some_billing(p):
    return p.billing.filter("billing_id % 2 = 0")


UNSUPPRESSED = f"""
{VISIT_ROWS}, sb AS (SELECT * FROM billing WHERE billing_id % 2 = 0),
pre AS (SELECT * FROM rp r WHERE NOT EXISTS (SELECT 1 FROM sb b JOIN vs ON vs.session_id = b.session_id AND vs.zone_id = b.zone_id WHERE vs.person_id = r.person_id AND vs.camera_id = r.camera_id AND vs.zone_id = r.zone_id AND vs.visit = r.visit)
  AND NOT EXISTS (SELECT 1 FROM sb b WHERE b.person_id = r.person_id AND b.zone_id = r.zone_id AND b.entered_at BETWEEN r.entered_at - INTERVAL 30 SECOND AND r.exited_at + INTERVAL 30 SECOND)),
seq AS (SELECT *, row_number() OVER (PARTITION BY person_id, zone_id ORDER BY entered_at, session_id) AS i FROM pre),
fold AS (
  SELECT person_id, zone_id, i, session_id, [entered_at] AS kept, true AS keep FROM seq WHERE i = 1
  UNION ALL
  SELECT s.person_id, s.zone_id, s.i, s.session_id, CASE WHEN len(list_filter(kept, lambda k: k BETWEEN s.entered_at - INTERVAL 30 SECOND AND s.exited_at + INTERVAL 30 SECOND)) = 0 THEN list_append(kept, s.entered_at) ELSE kept END, len(list_filter(kept, lambda k: k BETWEEN s.entered_at - INTERVAL 30 SECOND AND s.exited_at + INTERVAL 30 SECOND)) = 0
  FROM fold f JOIN seq s ON s.person_id = f.person_id AND s.zone_id = f.zone_id AND s.i = f.i + 1)"""


@query(f"WITH {UNSUPPRESSED} SELECT person_id, zone_id, session_id FROM fold WHERE keep")
def b6_unsuppressed_visits(p):
    return B.unsuppressed(B.repaired_visits(p.sessions, B.zone_dwell_by_session(p.events), staff(p)), some_billing(p)).select("person_id", "zone_id", "session_id")


@query(f"""
WITH {UNSUPPRESSED}
SELECT sha256(concat_ws('|', person_id, zone_id, session_id, CAST(entered_at AS VARCHAR))) AS billing_id, camera_id, person_id, session_id, zone_id, entered_at, exited_at, dwell AS dwell_seconds, 'repaired' AS interaction_type, 'billing_insert' AS kind, n AS fragments
FROM seq JOIN (SELECT person_id, zone_id, i FROM fold WHERE keep) USING (person_id, zone_id, i)""")
def b7_billing_and_audit_rows(p):
    found = cut(B.unsuppressed(B.repaired_visits(p.sessions, B.zone_dwell_by_session(p.events), staff(p)), some_billing(p)), "visits")
    return B.billing_rows(found).join(B.audit_rows(found).select("session_id", "person_id", "zone_id", "kind", "fragments"), ["session_id", "person_id", "zone_id"])


@query(f"""
WITH {UNSUPPRESSED}, fr AS (SELECT person_id, camera_id, zone_id, visit, list(session_id ORDER BY session_id) AS fragments FROM vs GROUP BY ALL),
ru AS (SELECT zone_id, camera_id, 30 + zone_id AS rule_id FROM (VALUES (0, NULL), (1, 3), (2, NULL), (2, 2)) t(zone_id, camera_id)),
mr AS (SELECT s.person_id, s.zone_id, s.i, min(rule_id) AS rule_id FROM seq s JOIN ru ON ru.zone_id = s.zone_id AND (ru.camera_id IS NULL OR ru.camera_id = s.camera_id) GROUP BY ALL)
SELECT sha256(concat_ws('|', 'event', s.person_id, s.zone_id, session_id, CAST(entered_at AS VARCHAR))) AS event_id, s.camera_id, rule_id, s.zone_id, s.person_id, session_id, 'billing_interaction' AS event_type, 'Low' AS severity,
  concat('Billing interaction (visit repair, ', CAST(round_even(dwell, 0) AS BIGINT), 's across ', n, ' fragments)') AS description,
  concat('{{"dwell_seconds":', dwell, ',"billing_visit_repair":true,"source":"fragmented_visit_sum","fragment_count":', n, ',"fragment_session_ids":', replace(CAST(fragments AS VARCHAR), ' ', ''), ',"dwell_threshold":20.0,"stitch_gap_seconds":60.0}}') AS metadata,
  entered_at AS occurred_at, false AS is_acknowledged, false AS is_false_positive
FROM seq s JOIN (SELECT person_id, zone_id, i FROM fold WHERE keep) USING (person_id, zone_id, i) JOIN fr ON fr.person_id = s.person_id AND fr.camera_id = s.camera_id AND fr.zone_id = s.zone_id AND fr.visit = s.visit LEFT JOIN mr ON mr.person_id = s.person_id AND mr.zone_id = s.zone_id AND mr.i = s.i""")
def b7_event_rows(p):
    """Billing rules 30 to 32 on the zones 0 to 2, one of them a camera's only; 28 and 29 are off or of another kind."""
    rules = [(30, 0, None, "billing_interaction", True), (31, 1, 3, "billing_interaction", True), (32, 2, None, "billing_interaction", True), (32, 2, 2, "billing_interaction", True), (28, 0, None, "billing_interaction", False), (29, 0, None, "zone_dwell", True)]
    table = p.spark.createDataFrame(rules, "rule_id int, zone_id int, camera_id int, rule_type string, is_enabled boolean")
    found = cut(B.unsuppressed(B.repaired_visits(p.sessions, B.zone_dwell_by_session(p.events), staff(p)), some_billing(p)), "visits")
    return B.event_rows(found, table)


@query(f"WITH {DW} SELECT zd.session_id, zd.zone_id, dwell, s.camera_id, s.person_id FROM zd JOIN sessions s USING (session_id) WHERE dwell >= 20 AND NOT EXISTS (SELECT 1 FROM billing b WHERE b.session_id = zd.session_id AND b.zone_id = zd.zone_id)")
def b8_threshold_backfill(p):
    return B.threshold_backfill(p.sessions, B.zone_dwell_by_session(p.events), p.billing)


@query("SELECT billing_id, CASE WHEN exited_at IS NOT NULL THEN epoch(exited_at - entered_at)::DOUBLE ELSE dwell_seconds END AS dwell_seconds FROM billing")
def b9_closed_interactions(p):
    return B.closed_interactions(p.billing).select("billing_id", "dwell_seconds")


@query(f"""
WITH {DW} SELECT CASE WHEN s.person_id IS NULL THEN 'no_person' WHEN s.person_id IN (SELECT person_id FROM persons WHERE is_staff) THEN 'staff' WHEN EXISTS (SELECT 1 FROM billing b WHERE b.session_id = s.session_id AND b.zone_id = zd.zone_id) THEN 'billed' WHEN dwell < 20 THEN 'short' ELSE 'candidate' END AS reason, count(*) AS n
FROM sessions s JOIN zd USING (session_id) GROUP BY 1""")
def b10_run_statistics(p):
    return B.run_statistics(p.sessions, B.zone_dwell_by_session(p.events), staff(p), p.billing)
