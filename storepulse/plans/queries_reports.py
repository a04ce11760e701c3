"""Queries: scans, scopes, expressions and reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from storepulse.functions import json_fields, scalars
from storepulse.functions.timeslots import default_range, resolve_range, slot, slot_label, spine
from storepulse.operators import reports as R
from storepulse.operators import scopes
from storepulse.plans.probes import AS_OF, END, START, ts
from storepulse.plans.registry import query
from storepulse.sources.tables import active_configuration

NOW = datetime.fromisoformat(AS_OF)
W = f"BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"
SHIFT = "INTERVAL 330 MINUTE"
STAFF = "person_id IS NOT NULL AND person_id NOT IN (SELECT person_id FROM persons WHERE is_staff)"


def cols(*names):
    return [F.col(n) for n in names]


@query(f"SELECT session_id, camera_id, person_id, started_at FROM sessions WHERE started_at {W} AND camera_id < 5")
def s1_table_scan(p):
    return scopes.within(p.sessions, "started_at", START, END).filter("camera_id < 5").select("session_id", "camera_id", "person_id", "started_at")


@query("SELECT event_id, CAST(json_extract_string(metadata, '$.dwell_seconds') AS DOUBLE) AS dwell, coalesce(list_contains(json_keys(metadata), 'dwell_seconds'), false) AS has_dwell FROM ev")
def s2_json_fields(p):
    return p.events.select("event_id", json_fields.dwell_seconds(F.col("metadata")).alias("dwell"), json_fields.has_key(F.col("metadata"), "dwell_seconds").alias("has_dwell"))


@query("""
SELECT session_id, nullif(trim(json_extract_string(o, '$.tier')), '') AS tier, nullif(trim(json_extract_string(o, '$.reason')), '') AS reason, CAST(json_extract_string(o, '$.score') AS DOUBLE) AS score, CAST(json_extract_string(o, '$.frames') AS INT) AS frames
FROM (SELECT session_id, CASE WHEN starts_with(trim(debug_json), '{') THEN debug_json END AS o FROM sessions)""")
def s3_session_debug(p):
    return p.sessions.select("session_id", json_fields.session_debug(F.col("debug_json")).alias("d")).select("session_id", "d.tier", "d.reason", "d.score", "d.frames")


DRAWN = """SELECT event_id, '{"points": ' || CASE WHEN k % 10 = 0 THEN '[[1, 2]]' ELSE '[[' || k || ', 0], [' || event_id % 640 || ', ' || k || '], [' || k || ', ' || event_id % 480 || ']]' END || '}' AS polygon, CASE WHEN event_id % 2 = 0 THEN 'line' ELSE 'polygon' END AS shape FROM raw"""


@query(f"""
SELECT event_id, CASE WHEN json_array_length(polygon, '$.points') >= 3 THEN CAST(json_array_length(polygon, '$.points') AS INT) END AS n_points, CAST(json_extract_string(polygon, '$.points[1][0]') AS DOUBLE) + 0 AS second_x,
  CASE WHEN shape = 'line' THEN CAST(json_extract_string(polygon, '$.points[1][1]') AS DOUBLE) END AS line_end_y FROM ({DRAWN})""")
def s4_polygons(p):
    three = F.concat(F.lit("[["), F.col("k"), F.lit(", 0], ["), F.expr("event_id % 640"), F.lit(", "), F.col("k"), F.lit("], ["), F.col("k"), F.lit(", "), F.expr("event_id % 480"), F.lit("]]"))
    polygon = F.concat(F.lit('{"points": '), F.when(F.col("k") % 10 == 0, "[[1, 2]]").otherwise(three), F.lit("}"))
    rows = p.raw.select("event_id", polygon.alias("polygon"), F.expr("CASE WHEN event_id % 2 = 0 THEN 'line' ELSE 'polygon' END").alias("shape"))
    poly, line = json_fields.points(F.col("polygon")), json_fields.line_ends(F.col("polygon"), F.col("shape"))
    second = F.get(F.get(json_fields.points(F.col("polygon"), 1), F.lit(1)), F.lit(0))
    return rows.select("event_id", F.when(poly.isNotNull(), F.size(poly)).alias("n_points"), second.alias("second_x"), F.get(F.get(line, F.lit(1)), F.lit(1)).alias("line_end_y"))


@query("""
SELECT c.camera_id, r.rule_id, r.rule_type, r.zone_id, z.name AS zone_name FROM cameras c JOIN rules r ON r.is_enabled AND (r.camera_id IS NULL OR r.camera_id = c.camera_id) LEFT JOIN zones z ON z.zone_id = r.zone_id AND z.is_active""")
def s5_active_configuration(p):
    return active_configuration(p.rules, p.zones, p.cameras)


@query("SELECT camera_id, 1 AS files, count(*) AS rows_in_files FROM ev GROUP BY camera_id")
def s6_object_listing(p):
    """One object a camera is written under a prefix; the listing names each once, and the rows are those read from what it names."""
    from storepulse.plans.lineage import new_path
    from storepulse.sources.tables import list_objects

    root = new_path(p.spark, "media")
    p.events.filter("camera_id IS NOT NULL").select("camera_id", "event_id").repartition("camera_id").write.partitionBy("camera_id").parquet(f"{root}/crops")
    found = list_objects(p.spark, f"{root}/crops").filter(F.endswith("path", F.lit(".parquet")) & (F.col("size") > 0))
    camera = F.regexp_extract("path", "/crops/camera_id=([0-9]+)/", 1).cast("int").alias("camera_id")
    held = p.spark.read.parquet(f"{root}/crops").groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"))
    rows = found.join(held, "path", "left")
    return rows.groupBy(camera).agg(F.count("*").cast("int").alias("files"), F.sum("rows").alias("rows_in_files"))


DAILY = """
WITH d AS (SELECT CAST(occurred_at AS DATE) AS summary_date, count(*) AS total_events, count(*) FILTER (WHERE event_type LIKE 'line_crossing%') AS total_footfall FROM ev GROUP BY 1),
s AS (SELECT CAST(started_at AS DATE) AS summary_date, count(DISTINCT person_id) AS unique_visitors, round(avg(epoch(coalesce(ended_at, last_seen_at) - started_at)), 4) AS avg_dwell_seconds FROM sessions WHERE {staff} GROUP BY 1),
b AS (SELECT CAST(entered_at AS DATE) AS summary_date, count(DISTINCT person_id) AS purchasers FROM billing WHERE {staff} GROUP BY 1)
SELECT summary_date, total_footfall, coalesce(unique_visitors, 0) AS unique_visitors, coalesce(purchasers, 0) AS purchasers, total_events, avg_dwell_seconds FROM d LEFT JOIN s USING (summary_date) LEFT JOIN b USING (summary_date)""".format(staff=STAFF)


@query(DAILY)
def s7_daily_upsert(p):
    """Written by date, one day written again, and read back."""
    from storepulse.plans.lineage import new_path
    from storepulse.sources.tables import upsert_by_date

    path = new_path(p.spark, "daily")
    days = R.daily_summary(p.sessions, p.persons, p.events, p.billing).drop("hourly_footfall")
    upsert_by_date(days.withColumn("total_events", F.lit(-1).cast("long")), path)
    upsert_by_date(days, path)
    return p.spark.read.parquet(path).select(*days.columns)


@query("SELECT person_id, count(*) AS n FROM sessions WHERE person_id IS NOT NULL GROUP BY person_id")
def s8_audit_append(p):
    from storepulse.plans.lineage import new_path
    from storepulse.sources.tables import append_audit

    path = new_path(p.spark, "audit")
    rows = p.sessions.filter("person_id IS NOT NULL").select("session_id", "person_id")
    append_audit(rows.filter("session_id % 2 = 0"), path)
    append_audit(rows.filter("session_id % 2 = 1"), path)
    return p.spark.read.parquet(path).groupBy("person_id").agg(F.count("*").alias("n"))


@query("SELECT billing_id, coalesce(b.person_id, s.person_id) AS person_id FROM billing b LEFT JOIN sessions s USING (session_id)")
def s10_snapshot_rewrite(p):
    from storepulse.operators.repair import fill_null_persons
    from storepulse.plans.lineage import new_path
    from storepulse.sources.tables import read_snapshot, write_snapshot

    root = new_path(p.spark, "billing")
    write_snapshot(p.billing, root)
    write_snapshot(fill_null_persons(read_snapshot(p.spark, root), p.sessions), root)
    return read_snapshot(p.spark, root).select("billing_id", "person_id")


@query(f"SELECT count(*) AS n, count(DISTINCT person_id) AS persons FROM sessions WHERE started_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND TIMESTAMP '{AS_OF}'")
def f1_default_range(p):
    return scopes.within(p.sessions, "started_at", *default_range(NOW)).agg(F.count("*").alias("n"), F.count_distinct("person_id").alias("persons"))


@query(f"""
WITH m AS (SELECT date_trunc('day', TIMESTAMP '{AS_OF}' + {SHIFT}) - {SHIFT} AS midnight)
SELECT count(*) FILTER (WHERE started_at BETWEEN midnight - INTERVAL 7 DAY AND TIMESTAMP '{AS_OF}') AS current, count(*) FILTER (WHERE started_at BETWEEN midnight - INTERVAL 14 DAY AND midnight - INTERVAL 7 DAY) AS previous FROM sessions, m""")
def f2_range_resolver(p):
    a, b, c, d = resolve_range("weekly", NOW)
    x = F.col("started_at")
    return p.sessions.agg(F.count_if(x.between(ts(str(a)), ts(str(b)))).alias("current"), F.count_if(x.between(ts(str(c)), ts(str(d)))).alias("previous"))


@query("SELECT camera_id, count(*) AS n FROM sessions WHERE camera_id IN (SELECT camera_id FROM cameras WHERE store_id = 2) GROUP BY camera_id")
def f3_scope_resolver(p):
    return scopes.in_scope(p.sessions, scopes.cameras_in_scope(p.cameras, store_id=2)).groupBy("camera_id").agg(F.count("*").alias("n"))


@query(f"SELECT person_id, visit_count FROM persons WHERE person_id IN (SELECT person_id FROM sessions WHERE started_at {W} AND camera_id IN (SELECT camera_id FROM cameras WHERE store_id = 1))")
def f4_seen_in_window(p):
    return scopes.seen_in_window(p.persons, p.sessions, START, END, scopes.cameras_in_scope(p.cameras, store_id=1)).select("person_id", "visit_count")


@query(f"SELECT session_id, person_id FROM sessions WHERE {STAFF}")
def f5_not_staff(p):
    return scopes.not_staff(p.sessions, p.persons).select("session_id", "person_id")


def case_bins(bins):
    return "CASE " + " ".join(f"WHEN estimated_age BETWEEN {a} AND {b} THEN '{k}'" for k, a, b in bins) + " ELSE 'unidentified' END"


@query(f"""
SELECT person_id, {case_bins(scalars.AGE_BINS)} AS six, {case_bins(scalars.AGE_GROUPS)} AS five, CASE WHEN estimated_age < 12 THEN 'child' WHEN estimated_age < 25 THEN 'young_adult' WHEN estimated_age < 60 THEN 'adult' WHEN estimated_age IS NOT NULL THEN 'senior' END AS coarse,
  CASE upper(trim(gender)) WHEN 'M' THEN 'male' WHEN 'F' THEN 'female' ELSE 'unidentified' END AS strict, CASE WHEN upper(trim(gender)) IN ('M', 'MALE') THEN 'male' WHEN upper(trim(gender)) IN ('F', 'FEMALE') THEN 'female' ELSE 'unidentified' END AS loose FROM persons""")
def f6_f9_bins_and_genders(p):
    age, g = cols("estimated_age", "gender")
    return p.persons.select("person_id", scalars.binned(age).alias("six"), scalars.binned(age, scalars.AGE_GROUPS).alias("five"), scalars.coarse_age(age).alias("coarse"), scalars.gender_strict(g).alias("strict"), scalars.gender_loose(g).alias("loose"))


@query(f"""
SELECT session_id, date_trunc('hour', l)::TIMESTAMP AS h, date_trunc('day', l)::TIMESTAMP AS d, date_trunc('week', l)::TIMESTAMP AS w, date_trunc('month', l)::TIMESTAMP AS m,
  ((hour(l) + 11) % 12 + 1) || CASE WHEN hour(l) < 12 THEN ' AM' ELSE ' PM' END AS hour_label,
  day(l) || CASE WHEN day(l) BETWEEN 11 AND 13 THEN 'th' WHEN day(l) % 10 = 1 THEN 'st' WHEN day(l) % 10 = 2 THEN 'nd' WHEN day(l) % 10 = 3 THEN 'rd' ELSE 'th' END || ' ' || strftime(l, '%b') AS day_label,
  strftime(l, '%Y-W%W') AS week_label, strftime(l, '%Y-%m') AS month_label
FROM (SELECT session_id, started_at + {SHIFT} AS l FROM sessions)""")
def f10_f11_slots_and_labels(p):
    x = F.col("started_at")
    local_day = slot(x, "day")
    return p.sessions.select("session_id", *(slot(x, g).alias(g[0]) for g in ("hour", "day", "week", "month")), slot_label(slot(x, "hour"), "hour").alias("hour_label"), slot_label(local_day, "day").alias("day_label"), slot_label(local_day, "week").alias("week_label"), slot_label(slot(x, "month"), "month").alias("month_label"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, date_trunc('week', o_orderdate)::TIMESTAMP AS w, strftime(o_orderdate, '%Y-W%W') AS label FROM orders")
def f11_week_labels_over_years(p):
    x = F.col("o_orderdate")
    return p.table("orders").select("o_orderkey", slot(x, "week", 0).alias("w"), slot_label(slot(x, "day", 0), "week").alias("label"))


@query(f"""
WITH s AS (SELECT CAST(i AS INT) AS position, TIMESTAMP '2024-01-10 05:00:00' + to_hours(CAST(i AS INT)) AS slot FROM range(24 * 7 + 1) t(i)),
e AS (SELECT date_trunc('hour', occurred_at + INTERVAL 330 MINUTE) AS slot, count(*) AS n FROM ev GROUP BY 1)
SELECT position, slot, coalesce(n, 0) AS events FROM s LEFT JOIN e USING (slot)""")
def f12_gapless_spine(p):
    counts = p.events.groupBy(slot(F.col("occurred_at"), "hour").alias("slot")).agg(F.count("*").alias("n"))
    return spine(p.spark, START, END, "hour").join(counts, "slot", "left").select("position", "slot", F.coalesce("n", F.lit(0)).alias("events"))


@query("""
WITH r(kind, a, b, step) AS (VALUES ('day', TIMESTAMP '2024-01-10 00:00:00', TIMESTAMP '2024-01-11 00:00:00', 'hour'), ('longer', TIMESTAMP '2024-01-10 00:00:00', TIMESTAMP '2024-01-11 00:00:01', 'day'), ('week', TIMESTAMP '2024-01-10 00:00:00', TIMESTAMP '2024-01-17 00:00:00', 'day')),
sl AS (SELECT kind, unnest(generate_series(date_trunc(step, a + INTERVAL 330 MINUTE), date_trunc(step, b + INTERVAL 330 MINUTE), CASE step WHEN 'hour' THEN INTERVAL 1 HOUR ELSE INTERVAL 1 DAY END)) AS slot FROM r),
n AS (SELECT kind, date_trunc(step, started_at + INTERVAL 330 MINUTE) AS slot, count(DISTINCT s.person_id) AS visitors FROM r JOIN sessions s ON started_at BETWEEN a AND b JOIN persons p ON p.person_id = s.person_id AND NOT p.is_staff GROUP BY ALL)
SELECT kind, slot, coalesce(visitors, 0) AS visitors FROM sl LEFT JOIN n USING (kind, slot)""")
def f12_auto_granularity(p):
    """Visitors by hour over a day, by day over anything longer."""
    parts = []
    for kind, start, end in (("day", START, "2024-01-11 00:00:00"), ("longer", START, "2024-01-11 00:00:01"), ("week", START, END)):
        rows = R.visitors_by_slot(p.sessions, p.persons, start, end, "auto")
        parts.append(rows.select(F.lit(kind).alias("kind"), "slot", "visitors"))
    return parts[0].union(parts[1]).union(parts[2])


@query("""
SELECT camera_id, n, bought, CASE WHEN bought <> 0 THEN round((n - bought) * 100.0::DOUBLE / bought, 1) END AS change, round(bought * 100.0::DOUBLE / greatest(n, 1), 1) AS conversion
FROM (SELECT camera_id, count(*) AS n, count(*) FILTER (WHERE session_id % 9 = 0) AS bought FROM sessions GROUP BY camera_id)""")
def f13_percent_change(p):
    n = p.sessions.groupBy("camera_id").agg(F.count("*").alias("n"), F.count_if(F.expr("session_id % 9 = 0")).alias("bought"))
    return n.select("*", scalars.percent_change(F.col("n"), F.col("bought")).alias("change"), scalars.conversion(F.col("bought"), F.col("n")).alias("conversion"))


@query("SELECT event_id, occurred_at FROM ev ORDER BY occurred_at DESC, event_id DESC LIMIT 25 OFFSET 50")
def f14_paging(p):
    return scopes.page(p.events.select("event_id", "occurred_at"), [F.desc("occurred_at"), F.desc("event_id")], 3, 25)


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 25.0) AS BIGINT) AS pages FROM ev")
def f14_total_pages(p):
    return scopes.total_pages(p.events, 25)


@query("SELECT camera_id, name FROM cameras WHERE name ILIKE '%n_1%' OR status ILIKE '%n_1%'")
def f15_search(p):
    return scopes.search(p.cameras, ["name", "status"], "N_1").select("camera_id", "name")


@query(f"SELECT event_id, camera_id, severity FROM ev WHERE event_type = 'billing_interaction' AND severity = 'High' AND occurred_at {W} AND NOT is_acknowledged AND NOT is_false_positive")
def f16_event_list(p):
    return scopes.list_events(p.events, event_type="billing_interaction", severity="High", acknowledged=False, start=START, end=END).select("event_id", "camera_id", "severity")


@query(f"SELECT billing_id AS id, camera_id FROM billing WHERE camera_id = 3 AND entered_at >= TIMESTAMP '{START}' UNION ALL SELECT size, camera_id FROM objects WHERE storage_type = 'snapshot' AND camera_id = 4")
def f17_billing_and_object_lists(p):
    return scopes.list_billing(p.billing, camera_id=3, start=START).select(F.col("billing_id").alias("id"), "camera_id").union(scopes.list_objects(p.objects, "snapshot", 4).select("size", "camera_id"))


@query(f"""
SELECT session_id, round(greatest(0.0, 1 - epoch(TIMESTAMP '{AS_OF}' - started_at) / 86400.0), 6)::DOUBLE AS score, CASE WHEN s < 60 THEN CAST(round_even(s, 0) AS BIGINT) || 's' WHEN s < 3600 THEN printf('%.1fm', s / 60) ELSE printf('%.1fh', s / 3600) END AS text
FROM (SELECT *, epoch(coalesce(ended_at, last_seen_at) - started_at)::DOUBLE AS s FROM sessions) WHERE (s::BIGINT // 20) % 3 <> 0""")
def f18_f19_decay_and_duration(p):
    s = R.session_seconds()
    rows = p.sessions.filter((s / 20).cast("long") % 3 != 0)
    return rows.select("session_id", F.round(scalars.decay(F.col("started_at"), ts(AS_OF)), 6).alias("score"), scalars.duration_text(s).alias("text"))


@query("SELECT DISTINCT path, CASE WHEN starts_with(path, 'media/') THEN substr(path, 7) ELSE path END AS key FROM objects")
def f20_object_key(p):
    return p.objects.select("path", scalars.object_key(F.col("path")).alias("key")).distinct()


AGENTS = """SELECT device, user_agent, ip_address, CASE WHEN o IS NULL THEN b ELSE b || ' on ' || o END AS label, sha256(user_agent || '|' || regexp_replace(ip_address, '\\.[0-9]+$', '')) AS hash FROM (
  SELECT *, CASE WHEN contains(a, 'edg/') THEN 'Edge' WHEN contains(a, 'chrome/') THEN 'Chrome' WHEN contains(a, 'firefox/') THEN 'Firefox' WHEN contains(a, 'safari/') THEN 'Safari' ELSE 'Unknown' END AS b,
    CASE WHEN contains(a, 'mac os') OR contains(a, 'macintosh') THEN 'macOS' WHEN contains(a, 'windows nt') THEN 'Windows' WHEN contains(a, 'linux') OR contains(a, 'x11') THEN 'Linux' WHEN contains(a, 'android') THEN 'Android' WHEN contains(a, 'iphone') THEN 'iOS' END AS o
  FROM (SELECT DISTINCT device, user_agent, ip_address, lower(user_agent) AS a FROM devices))"""


@query(AGENTS)
def f21_device_label(p):
    return p.devices.select("device", "user_agent", "ip_address").distinct().select("*", scalars.device_label(F.col("user_agent")).alias("label"), scalars.device_hash(F.col("user_agent"), F.col("ip_address")).alias("hash"))


CROP = "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN k / 100.0::DOUBLE END AS torso, CASE WHEN event_id % 7 <> 0 THEN (event_id % 100) / 100.0::DOUBLE END AS conf, value * 3 AS sharp, CAST(k * 5 AS DOUBLE) AS h, CAST(event_id % 150 AS DOUBLE) AS w, CAST((event_id * 7) % 256 AS DOUBLE) AS light FROM raw"


@query(f"""
SELECT event_id, CASE WHEN h >= 50 AND w >= 25 THEN round(greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    (CASE WHEN torso IS NULL THEN 0.0::DOUBLE ELSE 0.35::DOUBLE END + CASE WHEN conf IS NULL THEN CASE WHEN torso IS NULL THEN 0.6::DOUBLE ELSE 0.25::DOUBLE END ELSE 0.0::DOUBLE END) * coalesce(torso, 0.0::DOUBLE)
    + CASE WHEN conf IS NULL THEN 0.0::DOUBLE WHEN torso IS NULL THEN 0.6::DOUBLE ELSE 0.25::DOUBLE END * coalesce(conf, 0.0::DOUBLE) + 0.15::DOUBLE * least(1.0::DOUBLE, sharp / 500.0::DOUBLE) + 0.1::DOUBLE * least(1.0::DOUBLE, h * w / 32768.0::DOUBLE)
    + 0.1::DOUBLE * CASE WHEN h / nullif(w, 0) BETWEEN 1.5 AND 3.5 THEN 1.0::DOUBLE WHEN h / nullif(w, 0) BETWEEN 1.0 AND 4.5 THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END
    + 0.05::DOUBLE * CASE WHEN light < 30 OR light > 240 THEN 0.3::DOUBLE WHEN light < 60 OR light > 200 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END)), 3) ELSE 0.0::DOUBLE END AS quality FROM ({CROP})""")
def f22_crop_quality(p):
    x = p.raw.selectExpr("event_id", "CASE WHEN event_id % 5 <> 0 THEN k / 100.0D END AS torso", "CASE WHEN event_id % 7 <> 0 THEN (event_id % 100) / 100.0D END AS conf", "value * 3 AS sharp", "CAST(k * 5 AS DOUBLE) AS h", "CAST(event_id % 150 AS DOUBLE) AS w", "CAST((event_id * 7) % 256 AS DOUBLE) AS light")
    return x.select("event_id", scalars.crop_quality(*cols("torso", "conf", "sharp", "h", "w", "light")).alias("quality"))


@query("SELECT event_id, len(list_filter([k / 100.0, (k * 3 % 100) / 100.0, (event_id % 100) / 100.0, (event_id * 7 % 100) / 100.0], lambda c: c >= 0.5)) / 4.0::DOUBLE AS torso, len(list_filter([k / 100.0, (k * 3 % 100) / 100.0, (event_id % 100) / 100.0, (event_id * 7 % 100) / 100.0], lambda c: c >= 0.5)) >= 2 AS usable FROM raw")
def f23_torso_visibility(p):
    zero = F.lit(0.0)
    parts = [F.expr(x) for x in ("k / 100.0D", "(k * 3 % 100) / 100.0D", "(event_id % 100) / 100.0D", "(event_id * 7 % 100) / 100.0D")]
    points = F.array(*([zero] * 5), parts[0], parts[1], *([zero] * 4), parts[2], parts[3])
    t = scalars.torso_visibility(points)
    return p.raw.select("event_id", t.alias("torso"), (t >= 0.5).alias("usable"))


@query("""
SELECT event_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (1 - 0.35::DOUBLE) * d + 0.35::DOUBLE * (0.55::DOUBLE * least(1.0::DOUBLE, abs(k - 10.0::DOUBLE) / 100.0::DOUBLE / 0.35::DOUBLE) + 0.3::DOUBLE * greatest(0.0::DOUBLE, 1 - abs(n - 50.0::DOUBLE) / 50.0::DOUBLE) + 0.15::DOUBLE * greatest(0.0::DOUBLE, 1 - abs(e - 40.0::DOUBLE) / 120.0::DOUBLE * 4)))), 3) AS quality
FROM (SELECT event_id, CAST(k AS DOUBLE) AS k, (event_id % 97) / 97.0::DOUBLE AS d, CAST(event_id % 101 AS DOUBLE) AS n, CAST(event_id % 61 AS DOUBLE) AS e FROM raw)""")
def f24_face_quality(p):
    x = p.raw.selectExpr("event_id", "(event_id % 97) / 97.0D AS d", "named_struct('x1', 0.0D, 'y1', 0.0D, 'x2', 100.0D, 'y2', 120.0D) AS box", "array(array(10.0D, 40.0D), array(CAST(k AS DOUBLE), CAST(event_id % 61 AS DOUBLE)), array(CAST(event_id % 101 AS DOUBLE), 60.0D), array(0.0D, 0.0D), array(0.0D, 0.0D)) AS pts")
    return x.select("event_id", scalars.face_quality(*cols("d", "box", "pts")).alias("quality"))


@query("SELECT event_id, CASE WHEN k / 100.0 < 0.5 THEN 'low_score' WHEN event_id % 90 < 30 THEN 'too_small' WHEN (event_id * 7 % 100) / 100.0 < 0.25 THEN 'not_frontal' END AS fault FROM raw")
def f25_face_validity(p):
    return p.raw.select("event_id", scalars.face_fault(F.expr("k / 100.0D"), F.expr("event_id % 90"), F.expr("(event_id * 7 % 100) / 100.0D")).alias("fault"))


@query(f"SELECT session_id, time_bucket(INTERVAL 3 HOUR, started_at + {SHIFT}, TIMESTAMP '2000-01-01') - {SHIFT} AS chunk_start FROM sessions")
def f26_chunk_window(p):
    from storepulse.functions.timeslots import local

    at = F.window(local(F.col("started_at")), "3 hours")["start"] - F.expr("INTERVAL '330' MINUTE")
    return p.sessions.select("session_id", at.cast("timestamp_ntz").alias("chunk_start"))


@query(f"""
WITH r AS (SELECT * FROM ev WHERE occurred_at {W} AND event_type LIKE 'line_crossing%')
SELECT date_trunc('hour', occurred_at)::TIMESTAMP AS slot, count(*) AS total, count(DISTINCT person_id) AS unique_persons FROM r GROUP BY 1 UNION ALL SELECT NULL, count(*), count(DISTINCT person_id) FROM r""")
def a1_footfall(p):
    return R.footfall(p.events, START, END)


@query(f"SELECT (SELECT count(*) FROM billing WHERE entered_at {W} AND {STAFF}) AS customer_interactions, round(avg(dwell_seconds), 6) AS avg_dwell_all, max(dwell_seconds) AS max_dwell_all FROM billing WHERE entered_at {W}")
def a2_billing_stats(p):
    return R.billing_stats(p.billing, p.persons, START, END)[0]


@query(f"SELECT date_trunc('hour', entered_at)::TIMESTAMP AS slot, count(*) AS interactions FROM billing WHERE entered_at {W} GROUP BY 1")
def a2_billing_timeline(p):
    return R.billing_stats(p.billing, p.persons, START, END)[1]


@query(f"""
WITH r AS (SELECT camera_id, epoch(coalesce(ended_at, last_seen_at) - started_at)::DOUBLE AS s FROM sessions WHERE started_at {W} AND camera_id IN (SELECT camera_id FROM cameras WHERE store_id = 3))
SELECT camera_id, count(*) AS sessions, round(avg(s), 6) AS avg_dwell, max(s) AS max_dwell FROM r GROUP BY camera_id UNION ALL SELECT NULL, count(*), round(avg(s), 6), max(s) FROM r""")
def a3_dwell_stats(p):
    return R.dwell_stats(p.sessions, START, END, scopes.cameras_in_scope(p.cameras, store_id=3))


@query(f"SELECT zone_id, name, count(*) AS events FROM ev JOIN zones USING (zone_id) WHERE occurred_at {W} GROUP BY ALL")
def a4_zone_activity(p):
    return R.zone_activity(p.events, p.zones, START, END)


SEEN = f"SELECT * FROM persons WHERE NOT is_staff AND person_id IN (SELECT person_id FROM sessions WHERE started_at {W})"
SUMMARY = f"""
WITH seen AS ({SEEN})
SELECT visitors, male, female, child, young_adult, adult, senior, entries, purchasers, round(purchasers * 100.0::DOUBLE / greatest(visitors, 1), 1) AS conversion FROM
  (SELECT count(*) AS visitors, count(*) FILTER (WHERE gender = 'M') AS male, count(*) FILTER (WHERE gender = 'F') AS female, count(*) FILTER (WHERE estimated_age < 12) AS child, count(*) FILTER (WHERE estimated_age BETWEEN 12 AND 24) AS young_adult, count(*) FILTER (WHERE estimated_age BETWEEN 25 AND 59) AS adult, count(*) FILTER (WHERE estimated_age >= 60) AS senior FROM seen),
  (SELECT count(*) AS entries FROM ev WHERE occurred_at {W} AND event_type = 'line_crossing_forward'), (SELECT count(DISTINCT person_id) AS purchasers FROM billing WHERE entered_at {W} AND {STAFF})"""


@query(SUMMARY)
def a5_dashboard_summary(p):
    return R.dashboard_summary(p.persons, p.sessions, p.events, p.billing, START, END)


@query(f"""
WITH seen AS (SELECT {case_bins(scalars.AGE_BINS)} AS age_group, gender FROM ({SEEN})),
b AS (SELECT {case_bins(scalars.AGE_BINS)} AS age_group, count(*) AS purchasers FROM persons WHERE person_id IN (SELECT person_id FROM billing WHERE entered_at {W} AND {STAFF}) GROUP BY 1),
s AS (SELECT age_group, count(*) FILTER (WHERE gender = 'M') AS male, count(*) FILTER (WHERE gender = 'F') AS female, count(*) FILTER (WHERE gender IS NULL) AS unidentified, count(*) AS total FROM seen GROUP BY 1)
SELECT age_group, coalesce(male, 0) AS male, coalesce(female, 0) AS female, coalesce(unidentified, 0) AS unidentified, coalesce(total, 0) AS total, coalesce(purchasers, 0) AS purchasers
FROM (SELECT unnest([{', '.join(f"'{b[0]}'" for b in scalars.AGE_BINS)}, 'unidentified']) AS age_group) LEFT JOIN s USING (age_group) LEFT JOIN b USING (age_group)""")
def a6_demographics(p):
    return R.demographics(p.persons, p.sessions, p.billing, START, END)


def sql_spine(step: str, last: str, first: str = START) -> str:
    return f"SELECT unnest(generate_series(date_trunc('{step}', TIMESTAMP '{first}' + {SHIFT})::TIMESTAMP, date_trunc('{step}', TIMESTAMP '{last}' + {SHIFT})::TIMESTAMP, INTERVAL 1 {step})) AS slot"


@query(f"""
WITH s AS ({sql_spine('hour', END)}), c AS (SELECT date_trunc('hour', occurred_at + {SHIFT})::TIMESTAMP AS slot, count(*) FILTER (WHERE event_type = 'line_crossing_forward') AS entries, count(*) FILTER (WHERE event_type = 'line_crossing_backward') AS exits FROM ev WHERE occurred_at {W} GROUP BY 1)
SELECT slot, coalesce(entries, 0) AS entries, coalesce(exits, 0) AS exits FROM s LEFT JOIN c USING (slot)""")
def a7_entry_exit(p):
    return R.entry_exit(p.events, START, END)


def visitors_sql(step: str, start: str = START, end: str = END) -> str:
    return f"s AS ({sql_spine(step, end, start)}), c AS (SELECT date_trunc('{step}', started_at + {SHIFT})::TIMESTAMP AS slot, count(DISTINCT person_id) AS n FROM sessions WHERE started_at BETWEEN TIMESTAMP '{start}' AND TIMESTAMP '{end}' AND {STAFF} GROUP BY 1), v AS (SELECT slot, coalesce(n, 0) AS visitors FROM s LEFT JOIN c USING (slot))"


@query(f"WITH {visitors_sql('hour')} SELECT * FROM v")
def a8_visitors_by_slot(p):
    return R.visitors_by_slot(p.sessions, p.persons, START, END)


@query(f"""
WITH s AS ({sql_spine('day', END)}), c AS (SELECT date_trunc('day', started_at + {SHIFT})::TIMESTAMP AS slot, count(DISTINCT person_id) FILTER (WHERE p.gender = 'M') AS male, count(DISTINCT person_id) FILTER (WHERE p.gender = 'F') AS female, count(DISTINCT person_id) FILTER (WHERE p.gender IS NULL) AS unidentified
  FROM sessions JOIN persons p USING (person_id) WHERE started_at {W} AND NOT p.is_staff GROUP BY 1)
SELECT slot, coalesce(male, 0) AS male, coalesce(female, 0) AS female, coalesce(unidentified, 0) AS unidentified FROM s LEFT JOIN c USING (slot)""")
def a9_gender_by_slot(p):
    return R.gender_by_slot(p.sessions, p.persons, START, END)


@query(f"WITH s AS ({sql_spine('hour', END)}), c AS (SELECT date_trunc('hour', entered_at + {SHIFT})::TIMESTAMP AS slot, count(DISTINCT person_id) AS n FROM billing WHERE entered_at {W} AND {STAFF} GROUP BY 1) SELECT slot, coalesce(n, 0) AS purchasers FROM s LEFT JOIN c USING (slot)")
def a10_purchases_by_slot(p):
    return R.purchases_by_slot(p.billing, p.persons, START, END)


@query(f"SELECT camera_id, name, count(DISTINCT person_id) AS persons FROM sessions JOIN cameras USING (camera_id) WHERE started_at {W} AND {STAFF} GROUP BY ALL")
def a11_visitors_by_camera(p):
    return R.persons_by_camera(p.sessions, p.persons, p.cameras, "started_at", START, END)


@query(f"SELECT camera_id, name, count(DISTINCT person_id) AS persons FROM billing JOIN cameras USING (camera_id) WHERE entered_at {W} AND {STAFF} GROUP BY ALL")
def a11_purchasers_by_camera(p):
    return R.persons_by_camera(p.billing, p.persons, p.cameras, "entered_at", START, END)


BEFORE = ("2024-01-03 00:00:00", START)


def two_periods(p):
    return R.visitors_by_slot(p.sessions, p.persons, START, END, "day"), R.visitors_by_slot(p.sessions, p.persons, *BEFORE, "day")


@query(f"""
WITH {visitors_sql('day')}, {visitors_sql('day', *BEFORE).replace('s AS (', 's2 AS (', 1).replace(', c AS (', ', c2 AS (', 1).replace(', v AS (', ', v2 AS (', 1).replace('FROM s LEFT JOIN c USING', 'FROM s2 LEFT JOIN c2 USING')},
a AS (SELECT CAST(row_number() OVER (ORDER BY slot) AS INT) AS position, slot, visitors AS current FROM v), b AS (SELECT row_number() OVER (ORDER BY slot) AS position, visitors AS previous FROM v2)
SELECT a.position, slot, current, previous, CASE WHEN previous <> 0 THEN round((current - previous) * 100.0::DOUBLE / previous, 1) END AS change FROM a LEFT JOIN b ON a.position = b.position""")
def a12_compare_periods(p):
    return R.compare_periods(*two_periods(p), "visitors")


PEAKS = """
(SELECT arg_max(slot, {'v': visitors, 't': -epoch(slot)}) AS peak_hour, max(visitors) AS peak, sum(visitors) AS total, count(*) AS hours FROM v),
(SELECT arg_max(day, {'n': n, 't': -epoch(day)}) AS busiest_day, CAST(max(n) AS BIGINT) AS busiest, count(*) AS days FROM (SELECT date_trunc('day', slot)::TIMESTAMP AS day, sum(visitors) AS n FROM v GROUP BY 1 HAVING sum(visitors) > 0))"""


@query(f"WITH {visitors_sql('hour')} SELECT peak_hour, peak, busiest_day, busiest, CAST(floor(total / greatest(days, 1)) AS BIGINT) AS per_day, round(total / hours::DOUBLE, 4) AS per_hour FROM {PEAKS}")
def a13_peaks(p):
    return R.peaks(R.visitors_by_slot(p.sessions, p.persons, START, END), "visitors")


LABEL = """
h AS (SELECT hour(slot) AS hour, arg_max(visitors, slot) AS n FROM v GROUP BY 1), hot AS (SELECT hour, hour - row_number() OVER (ORDER BY hour) AS run FROM h WHERE n >= 0.7 * greatest(1, (SELECT max(n) FROM h))),
g AS (SELECT min(hour) AS a, max(hour) + 1 AS b FROM hot GROUP BY run ORDER BY 1 LIMIT 2),
label AS (SELECT string_agg(((a + 11) % 12 + 1) || CASE WHEN a < 12 THEN ' AM' ELSE ' PM' END || ' – ' || ((b + 11) % 12 + 1) || CASE WHEN b % 24 < 12 THEN ' AM' ELSE ' PM' END, ' and ' ORDER BY a) AS peak_hours FROM g)"""


@query(f"WITH {visitors_sql('hour')}, {LABEL} SELECT * FROM label")
def a14_peak_hours_label(p):
    return R.peak_hours_label(R.visitors_by_slot(p.sessions, p.persons, START, END), "visitors")


@query(f"SELECT CASE gender WHEN 'M' THEN 'male' WHEN 'F' THEN 'female' ELSE 'unidentified' END AS gender, count(*) AS persons, round(count(*) * 100.0::DOUBLE / (sum(count(*)) OVER ())::BIGINT, 1) AS percent FROM ({SEEN}) GROUP BY 1")
def a15_gender_tab(p):
    return R.gender_tab(p.persons, p.sessions, START, END)


@query(f"""
WITH c AS (SELECT {case_bins(scalars.AGE_BINS)} AS g, count(*) AS n FROM ({SEEN}) GROUP BY 1), o AS (SELECT *, list_position([{', '.join(f"'{b[0]}'" for b in scalars.AGE_BINS)}], g) AS k FROM c)
SELECT CAST(sum(n) FILTER (WHERE g <> 'unidentified') AS BIGINT) AS identified, CAST(coalesce(sum(n) FILTER (WHERE g = 'unidentified'), 0) AS BIGINT) AS unidentified, (SELECT g || ' dominant' FROM o WHERE g <> 'unidentified' ORDER BY n DESC, k LIMIT 1) AS peak_group FROM o""")
def a16_age_tab(p):
    return R.age_tab(p.persons, p.sessions, p.billing, START, END)


@query(f"""
WITH {visitors_sql('hour')}, {LABEL}, q AS (SELECT CAST(sum(n) AS BIGINT) AS previous_total FROM (SELECT count(DISTINCT person_id) AS n FROM sessions WHERE started_at BETWEEN TIMESTAMP '{BEFORE[0]}' AND TIMESTAMP '{BEFORE[1]}' AND {STAFF} GROUP BY date_trunc('hour', started_at + {SHIFT})))
SELECT CAST(total AS BIGINT) AS total, previous_total, CASE WHEN previous_total <> 0 THEN round((total - previous_total)::BIGINT * 100.0::DOUBLE / previous_total, 1) END AS change, peak_hour, peak, busiest_day, busiest, CAST(floor(total / greatest(days, 1)) AS BIGINT) AS per_day, round(total / hours::DOUBLE, 4) AS per_hour, peak_hours FROM {PEAKS}, label, q""")
def a17_metric_tab(p):
    return R.metric_tab(R.visitors_by_slot(p.sessions, p.persons, START, END), R.visitors_by_slot(p.sessions, p.persons, *BEFORE), "visitors")


@query()
def a18_dashboard(p):
    return R.dashboard(p.persons, p.sessions, p.events, p.billing, p.cameras, START, END)


HOURLY = """
WITH h AS (SELECT CAST(occurred_at AS DATE) AS summary_date, CAST(hour(occurred_at) AS VARCHAR) AS h, count(*) AS n FROM ev WHERE event_type LIKE 'line_crossing%' GROUP BY ALL),
m AS (SELECT summary_date, concat('{', string_agg(concat('"', h, '":', n), ',' ORDER BY h), '}') AS hourly_footfall FROM h GROUP BY 1)"""


@query(f"{HOURLY} SELECT d.*, hourly_footfall FROM ({DAILY}) d LEFT JOIN m USING (summary_date)")
def a19_daily_summary(p):
    return R.daily_summary(p.sessions, p.persons, p.events, p.billing).withColumn("hourly_footfall", F.to_json("hourly_footfall"))


@query(f"""
SELECT s.store_id, s.name, (SELECT count(*) FROM cameras c WHERE c.store_id = s.store_id) AS cameras, (SELECT count(DISTINCT person_id) FROM sessions JOIN cameras c USING (camera_id) WHERE c.store_id = s.store_id AND started_at {W} AND {STAFF}) AS visitors,
  (SELECT count(DISTINCT person_id) FROM billing JOIN cameras c USING (camera_id) WHERE c.store_id = s.store_id AND entered_at {W} AND {STAFF}) AS purchasers FROM stores s""")
def a20_store_rollup(p):
    return R.store_rollup(p.stores, p.cameras, p.sessions, p.billing, p.persons, START, END)


@query(f"""
SELECT person_id, is_staff, (SELECT count(*) FROM sessions s WHERE s.person_id = p.person_id) AS tracks, (SELECT count(DISTINCT CAST(started_at + {SHIFT} AS DATE)) FROM sessions s WHERE s.person_id = p.person_id) AS days, (SELECT count(*) FROM billing b WHERE b.person_id = p.person_id) AS purchases
FROM persons p WHERE NOT is_staff AND person_id IN (SELECT person_id FROM sessions WHERE started_at {W}) AND EXISTS (SELECT 1 FROM billing b WHERE b.person_id = p.person_id)""")
def a21_person_list(p):
    return R.person_list(p.persons, p.sessions, p.billing, True, False, START, END)


@query(f"""
SELECT session_id, camera_id, person_id, started_at, (SELECT count(*) FROM billing b WHERE b.session_id = s.session_id) AS billings, coalesce(has_face, false) AS has_face, is_staff, visit_count FROM sessions s LEFT JOIN persons USING (person_id) WHERE started_at {W} AND person_id IS NOT NULL""")
def a22_session_browser(p):
    return R.session_browser(p.sessions, p.billing, p.persons, True, START, END)


@query(f"""
SELECT camera_id, count(*) AS viewers, count(DISTINCT device) AS devices, round(sum(round(epoch(TIMESTAMP '{AS_OF}' - login_at) / 60, 1)), 1) AS minutes FROM devices WHERE last_active_at >= TIMESTAMP '{AS_OF}' - INTERVAL 120 MINUTE AND login_at <= TIMESTAMP '{AS_OF}' AND ended_at IS NULL GROUP BY camera_id""")
def a23_live_viewers(p):
    return R.live_viewers(p.devices, AS_OF, 120)


@query(f"""
WITH ag AS ({AGENTS}), v AS (SELECT *, count(*) OVER (PARTITION BY camera_id) AS active_viewers FROM devices WHERE ended_at IS NULL)
SELECT v.camera_id, coalesce(c.name, 'Unknown') AS camera, active_viewers, ag.hash AS device_hash, ag.label AS device_label, v.ip_address, login_at AS viewing_since, round(epoch(TIMESTAMP '{AS_OF}' - login_at) / 60, 1) AS minutes
FROM v LEFT JOIN (SELECT * FROM cameras WHERE camera_id <> 7) c USING (camera_id) JOIN ag USING (device, user_agent, ip_address)""")
def a23_viewer_list(p):
    """Camera 7 is not known here."""
    return R.viewer_list(p.devices, p.cameras.filter("camera_id <> 7"), AS_OF)


@query(f"SELECT count(*) FILTER (WHERE is_active AND last_active_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1800 SECOND) AS connected, count(*) FILTER (WHERE ended_at IS NULL) AS watching FROM devices")
def a23_viewer_totals(p):
    return R.viewer_totals(p.devices, p.devices, AS_OF)


@query("""
SELECT k AS session_id, arg_max(person_id, {'t': occurred_at, 'e': event_id}) FILTER (WHERE person_id IS NOT NULL) AS person_id, arg_max(camera_id, {'t': occurred_at, 'e': event_id}) AS camera_id, max(CAST(json_extract_string(metadata, '$.dwell_seconds') AS DOUBLE)) AS max_dwell, min(occurred_at) AS first_at FROM (SELECT *, event_id % 500 AS k FROM ev) GROUP BY k""")
def a24_last_known(p):
    return R.last_known(p.events.withColumn("session_id", F.expr("event_id % 500")))


@query(f"SELECT CAST(entered_at + {SHIFT} AS DATE) AS day, count(*) AS billings, count(*) FILTER (WHERE b.person_id IS NULL) AS without_person, count(*) FILTER (WHERE b.person_id IS NULL AND s.person_id IS NOT NULL) AS fillable FROM billing b LEFT JOIN sessions s USING (session_id) GROUP BY 1")
def a25_null_billing_by_day(p):
    return R.null_billing_by_day(p.billing, p.sessions)


@query("SELECT k AS person_id, count(*) FILTER (WHERE gender = 'M') AS m, count(*) FILTER (WHERE gender = 'F') AS f FROM (SELECT CAST(session_id % 400 AS BIGINT) AS k, gender FROM sessions) GROUP BY k HAVING m > 0 AND f > 0")
def a26_mixed_gender_persons(p):
    return R.mixed_gender_persons(p.sessions.withColumn("person_id", F.expr("session_id % 400")))


@query("SELECT person_id, count(DISTINCT camera_id) AS cameras FROM faces GROUP BY person_id HAVING cameras >= 2")
def a26_multi_camera_persons(p):
    return R.multi_camera_persons(p.faces)


@query("SELECT CAST(hour(entered_at) AS INT) AS hour, count(*) AS purchases FROM billing WHERE CAST(entered_at AS DATE) = DATE '2024-01-12' GROUP BY ROLLUP (1)")
def a27_purchases_of_day(p):
    return p.billing.filter("entered_at >= TIMESTAMP_NTZ '2024-01-12' AND entered_at < TIMESTAMP_NTZ '2024-01-13'").rollup(F.hour("entered_at").alias("hour")).agg(F.count("*").alias("purchases"))


@query(f"SELECT CAST(t AS INT) AS threshold, (SELECT count(DISTINCT person_id) FROM billing WHERE {STAFF} AND dwell_seconds >= t) AS purchasers FROM (SELECT unnest([5, 10, 15, 20, 30, 60, 120]) AS t)")
def a28_dwell_sweep(p):
    return R.dwell_sweep(p.billing, p.persons)


@query("""
WITH c AS (SELECT CAST(occurred_at AS DATE) AS day, count(DISTINCT person_id) AS n FROM ev GROUP BY 1), r AS (SELECT CAST(started_at AS DATE) AS day, count(DISTINCT session_id % 140) AS n FROM sessions GROUP BY 1)
SELECT day, c.n AS computed, r.n AS reported, CASE WHEN r.n <> 0 THEN round((c.n - r.n) * 100.0::DOUBLE / r.n, 1) END AS error FROM c JOIN r USING (day)""")
def a29_reconcile(p):
    c = p.events.groupBy(F.to_date("occurred_at").alias("day")).agg(F.count_distinct("person_id").alias("n"))
    r = p.sessions.groupBy(F.to_date("started_at").alias("day")).agg(F.count_distinct(F.expr("session_id % 140")).alias("n"))
    return R.reconcile(c, r, "n")


@query("SELECT CAST(floor(estimated_age / 10.0) * 10 AS BIGINT) AS bin, count(*) AS n FROM persons WHERE estimated_age IS NOT NULL GROUP BY 1")
def a32_age_histogram(p):
    return R.age_histogram(p.persons)


@query("SELECT round(quantile_cont(estimated_age, 0.1), 4) AS p10, round(quantile_cont(estimated_age, 0.5), 4) AS p50, round(quantile_cont(estimated_age, 0.9), 4) AS p90, round(avg(estimated_age), 4) AS mean FROM persons")
def a32_age_percentiles(p):
    return R.age_percentiles(p.persons)


@query("SELECT store_id, s.name, count(*) AS n, string_agg(c.name, ', ' ORDER BY c.name) AS cameras FROM stores s JOIN cameras c USING (store_id) GROUP BY ALL")
def a33_cameras_by_store(p):
    return R.cameras_by_store(p.stores, p.cameras)


@query(f"WITH ag AS ({AGENTS}) SELECT device, ip_address, last_active_at, label, count(*) OVER () AS n FROM devices JOIN ag USING (device, user_agent, ip_address) WHERE user_id = 7 AND is_active AND expires_at > TIMESTAMP '{AS_OF}'")
def a34_active_devices(p):
    return R.active_devices(p.devices, 7, AS_OF)


@query("""
SELECT session_id, camera_id, name, started_at, epoch(coalesce(ended_at, last_seen_at) - started_at)::DOUBLE AS duration, epoch(started_at - lag(coalesce(ended_at, last_seen_at)) OVER (ORDER BY started_at, session_id))::DOUBLE AS gap FROM sessions JOIN cameras USING (camera_id) WHERE person_id = 7""")
def w11_journey(p):
    return R.journey(p.sessions, p.cameras, 7)


@query(f"""
WITH hours AS ({sql_spine('hour', END)}), c AS (SELECT store_id, date_trunc('hour', started_at + {SHIFT})::TIMESTAMP AS slot, count(DISTINCT person_id) AS n FROM sessions JOIN cameras USING (camera_id) WHERE started_at {W} AND {STAFF} GROUP BY ALL)
SELECT store_id, name, slot, coalesce(n, 0) AS visitors FROM stores CROSS JOIN hours LEFT JOIN c USING (store_id, slot)""")
def visitors_by_store_and_hour(p):
    """Distinct non-staff visitors per local hour and store, gapless."""
    seen = scopes.not_staff(scopes.within(p.sessions, "started_at", START, END), p.persons).join(F.broadcast(p.cameras.select("camera_id", "store_id")), "camera_id")
    counts = seen.groupBy("store_id", slot(F.col("started_at")).alias("slot")).agg(F.count_distinct("person_id").alias("n"))
    # stores x hours: the size of the result
    grid = p.stores.select("store_id", "name").crossJoin(F.broadcast(spine(p.spark, START, END).select("slot")))
    return grid.join(counts, ["store_id", "slot"], "left").select("store_id", "name", "slot", F.coalesce("n", F.lit(0)).alias("visitors"))
