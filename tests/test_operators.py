"""Literal cases and properties of operators that SQL does not express."""

from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from storepulse.functions import geometry, scalars
from storepulse.functions.timeslots import resolve_range
from storepulse.operators import detections, identity, intervals, maintenance, repair, reports, spacing, windows
from storepulse.operators.components import connected_components
from storepulse.plans.probes import Probes
from storepulse.sources.streams import DETECTIONS, detections_stream, end_of_detections, rows_stream, write_in_slices
from storepulse.sources.tables import list_objects, read_snapshot, write_snapshot
from storepulse.streaming import identities, runs, tracks
from storepulse.thresholds import DEFAULTS

BASE = datetime(2026, 7, 31, 10)


def sessions_of(spark, rows):
    data = [(i, 1, 7, BASE + timedelta(seconds=a), BASE + timedelta(seconds=a + n)) for i, (a, n) in enumerate(rows)]
    return spark.createDataFrame(data, "session_id long, camera_id int, person_id long, start timestamp_ntz, end timestamp_ntz")


@pytest.mark.parametrize(("rows", "want"), [([(0, 20)], 1), ([(0, 20), (25, 20), (50, 15)], 1), ([(0, 20), (200, 20)], 2), ([(0, 60), (10, 60)], 2)])
def test_visit_clusters(spark, rows, want):
    assert windows.visits(sessions_of(spark, rows), 60.0).select("visit").distinct().count() == want


def test_gaps(spark):
    for (a, b, c, d), want in (((0, 13, 20, 44), 7.0), ((0, 60, 10, 70), None), ((0, 10, 10, 20), 0.0)):
        s = [F.lit(BASE + timedelta(seconds=x)).cast("timestamp_ntz") for x in (a, b, c, d)]
        assert spark.range(1).select(intervals.gap_seconds(*s)).first()[0] == want


@pytest.mark.parametrize(
    ("days", "staff"),
    [([0, 1, 2, 3, 4], True), ([0, 1, 2, 3], False), ([0, 1, 2, 3, 5, 6, 7, 8, 10, 11, 12], True), ([0, 1, 2, 3, 5, 6, 7, 8, 10, 11], False), ([0, 1, 2, 3, 6, 7, 8, 9, 12, 13, 14], True), ([0, 2, 4, 6, 8, 10, 12, 20, 22], False), ([], False), ([0, 10, 11, 12, 13, 14], True)],
)
def test_staff_rule(spark, days, staff):
    df = spark.createDataFrame([(1, (datetime(2026, 8, 1) + timedelta(days=d)).date()) for d in days], "person_id long, day date")
    assert (windows.staff_by_days(df).count() == 1) == staff


def test_geometry(spark):
    square = F.array(*(F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (100, 0), (100, 100), (0, 100))))
    for (x, y), want in (((50, 50), True), ((150, 50), False), ((-10, -10), False), ((0, 50), False), ((100, 100), False)):
        assert spark.range(1).select(geometry.in_polygon(F.lit(float(x)), F.lit(float(y)), square)).first()[0] is want
    box = F.struct(*(F.lit(float(v)).alias(n) for n, v in (("x1", 10), ("y1", 20), ("x2", 50), ("y2", 100))))
    row = spark.range(1).select(*geometry.centre(box), *geometry.feet(box), geometry.area(box)).first()
    assert tuple(row) == (30, 60, 30, 100, 3200)
    line = F.array(F.array(F.lit(0.0), F.lit(50.0)), F.array(F.lit(100.0), F.lit(50.0)))
    cross = lambda *p: spark.range(1).select(geometry.crossing(*(F.lit(float(v)) for v in p), line)).first()[0]
    assert (cross(50, 30, 50, 70), cross(50, 70, 50, 30), cross(50, 10, 50, 20), cross(10, 50, 20, 50)) == ("forward", "backward", None, None)


def test_zone_membership(spark):
    zones = spark.createDataFrame([(1, 1, True, "polygon", '{"points": [[0, 0], [100, 0], [100, 100], [0, 100]]}'), (2, 2, True, "polygon", '{"points": [[0, 0], [10, 0], [10, 10], [0, 10]]}')], "zone_id int, camera_id int, is_active boolean, shape string, polygon string")
    rows = [(1, 1, BASE, (40.0, 40.0, 60.0, 60.0), 0.9, 1920, 1080), (2, 1, BASE, (400.0, 400.0, 420.0, 460.0), 0.9, 1920, 1080)]
    df = spark.createDataFrame(rows, "camera_id int, local_track_id int, frame_ts timestamp_ntz, bbox struct<x1:double,y1:double,x2:double,y2:double>, confidence double, frame_width int, frame_height int")
    assert {r.camera_id: r.zones for r in detections.zone_membership(df, zones).collect()} == {1: [1], 2: []}


def test_accept_thresholds(spark):
    tiers = ["face_recent", "face", "body_recent", "body", "staff"]
    df = spark.createDataFrame([(t,) for t in tiers], "tier string").select("tier", identity.accept_threshold(F.col("tier")).alias("x"))
    assert {r.tier: r.x for r in df.collect()} == dict(zip(tiers, [0.35, 0.40, 0.55, 0.50, 0.70], strict=True))


def unit(*cosines):
    """Vectors whose cosine with the first axis is as given, apart from each other otherwise."""
    n = len(cosines) + 1
    return [[c, *(np.sqrt(1 - c * c) if j == i else 0.0 for j in range(1, n))] for i, c in enumerate(cosines, 1)]


def world(spark, face_sim=None, body_sims=(), recent=True):
    """One probe along the first axis; person 1 has a face at face_sim; persons 2, 3 have two bodies each at body_sims."""
    width = 12
    pad = lambda v: [float(x) for x in [*v, *[0.0] * (width - len(v))]]
    far = pad([0.0, 0.0, 0.0, 0.0, 0.0, 1.0])
    seen = BASE if recent else BASE - timedelta(days=2)
    persons = spark.createDataFrame([(p, seen, False) for p in (1, 2, 3)], "person_id long, last_seen_at timestamp_ntz, is_staff boolean")
    faces = spark.createDataFrame([(1, 1, pad(unit(face_sim)[0]) if face_sim is not None else far)], "face_id long, person_id long, embedding array<double>")
    bodies = []
    for p, s in zip((2, 3), body_sims, strict=False):
        for i in range(2):
            v = [s, *[0.0] * (width - 1)]
            v[2 * p + i] = np.sqrt(1 - s * s)
            bodies.append((10 * p + i, p, [float(x) for x in v], seen))
    bodies = spark.createDataFrame(bodies, "body_id long, person_id long, embedding array<double>, captured_at timestamp_ntz")
    probe = [(1, 1, BASE, BASE + timedelta(seconds=30), pad([1.0]), pad([1.0]))]
    probes = spark.createDataFrame(probe, "query long, camera_id int, start timestamp_ntz, end timestamp_ntz, embedding array<double>, body array<double>")
    return probes, persons, faces, bodies


NO_SESSIONS = "session_id long, camera_id int, person_id long, started_at timestamp_ntz, last_seen_at timestamp_ntz, ended_at timestamp_ntz"


@pytest.mark.parametrize(
    ("face", "bodies", "recent", "person", "tier", "reason"),
    [(0.45, (), False, 1, "face", "matched"), (0.37, (), True, 1, "face_recent", "matched"), (0.37, (), False, None, None, "no_candidate"), (None, (0.70, 0.69), True, None, "body_recent", "ambiguous"), (None, (0.70, 0.52), True, 2, "body_recent", "matched"), (None, (0.52,), False, 2, "body", "matched"), (0.45, (0.9,), True, 1, "face", "matched")],
)
def test_match_tiers(spark, face, bodies, recent, person, tier, reason):
    out = identity.match_identities(*world(spark, face, bodies, recent), spark.createDataFrame([], NO_SESSIONS), BASE).collect()
    assert [(r.person_id, r.tier, r.reason) for r in out] == [(person, tier, reason)]


def test_match_blocked_by_overlap(spark):
    other = spark.createDataFrame([(99, 1, 1, BASE - timedelta(seconds=60), BASE + timedelta(seconds=60), None)], NO_SESSIONS)
    out = identity.match_identities(*world(spark, 0.45), other, BASE).first()
    assert (out.person_id, out.accepted, out.reason) == (None, False, "overlap")


def test_crop_quality_bounds(spark):
    q = lambda *v: spark.range(1).select(scalars.crop_quality(*(F.lit(x).cast("double") for x in v))).first()[0]
    assert q(None, None, 100.0, None, None, 100.0) == 0.0 and q(1.0, 1.0, 900.0, 49.0, 100.0, 100.0) == 0.0
    assert q(1.0, 1.0, 900.0, 300.0, 150.0, 100.0) == 1.0 and 0 <= q(None, 0.5, 10.0, 100.0, 80.0, 250.0) <= 1


def test_ranges():
    now = datetime(2024, 1, 25, 12)
    assert resolve_range("today", now)[0] == datetime(2024, 1, 24, 18, 30)
    a, b, c, d = resolve_range("weekly", now)
    assert (b - a, d - c, d) == (timedelta(days=7, hours=17, minutes=30), timedelta(days=7), a)
    assert resolve_range("custom", now, now - timedelta(days=2), now)[2:] == (now - timedelta(days=4), now - timedelta(days=2))
    with pytest.raises(ValueError):
        resolve_range("monthly", now)


def test_components_of_long_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(0, 200)]
    hub = [(1000, i) for i in range(1001, 1200)]
    df = spark.createDataFrame([*chain, *hub, (5, 5), (None, 3), (7, None), *chain[:10]], "a long, b long")
    out = {r.node: r.component for r in connected_components(df).collect()}
    assert out == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1200)}}
    assert connected_components(df.limit(0)).collect() == []


def test_few_edges_are_contracted_without_a_star_round(spark, monkeypatch):
    from storepulse.operators import components

    monkeypatch.setattr(components, "_large_star", lambda *_: pytest.fail("a round of star steps for a few edges"))
    df = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(1000, i) for i in range(1001, 1500)], "a long, b long").repartition(16)
    out = {r.node: r.component for r in connected_components(df).collect()}
    assert out == {**{i: 0 for i in range(501)}, **{i: 1000 for i in range(1000, 1500)}}
    names = spark.createDataFrame([("b", "a"), ("c", "b"), ("e", "d")], "a string, b string")
    assert {tuple(r) for r in connected_components(names).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}


def test_components_of_more_edges_than_a_task_contracts(spark):
    import random

    for seed in range(2):
        draw = random.Random(seed)
        edges = [(draw.randrange(600), draw.randrange(600)) for _ in range(350)] + [(2000 + i, 2001 + i) for i in range(60)]
        least = {x: x for e in edges for x in e if e[0] != e[1]}
        for _ in least:
            for x, y in edges:
                if x != y:
                    least[x] = least[y] = min(least[x], least[y])
        df = spark.createDataFrame(edges, "a long, b long").repartition(8)
        assert {r.node: r.component for r in connected_components(df, chunk=16).collect()} == least


def test_contamination_of_two_removes_the_best_scored(spark):
    df = spark.createDataFrame([(1, 10, 0.9, [1.0, 0.0]), (1, 11, 0.5, [0.0, 1.0])], "person_id long, face_id long, face_score double, embedding array<double>")
    assert [r.face_id for r in maintenance.contaminated(df, "face_id", "face_score", 0.35, 2).collect()] == [10]


def test_kept_sessions_are_free_of_conflicts(spark, sf_dir):
    p = Probes(spark, sf_dir)
    s = p.sessions.withColumn("person_id", F.col("person_id") % 3).withColumn("camera_id", F.col("camera_id") % 4)
    rest = maintenance.orphaned(s, maintenance.overlap_losers(s))
    assert intervals.overlapping_sessions(rest, 1.0).count() == 0


def test_repair_again_inserts_nothing(spark, sf_dir):
    p = Probes(spark, sf_dir)
    staff, dwell = p.persons.filter("is_staff").select("person_id"), repair.zone_dwell_by_session(p.events)
    found = repair.repaired_visits(p.sessions, dwell, staff)
    first = repair.unsuppressed(found, p.billing)
    rows = repair.billing_rows(first)
    assert rows.count() > 0
    columns = ["camera_id", "person_id", "session_id", "zone_id", "entered_at"]
    billing = p.billing.select(*columns).unionByName(rows.select(*columns))
    assert repair.unsuppressed(found, billing).count() == 0


def test_assignment_is_one_to_one(spark, sf_dir):
    p = Probes(spark, sf_dir)
    d = p.detections.withColumn("camera_id", F.lit(1))
    out = detections.assign_faces(detections.face_candidates(detections.probe_faces(d), d, least_score=0.0))
    for c in ("face", "track"):
        assert out.groupBy("camera_id", "frame_ts", c).count().filter("count > 1").count() == 0


def test_replay_outcomes(spark):
    v = lambda *x: [float(i) for i in x]
    minute = timedelta(minutes=1)
    rows = [(1, BASE, BASE + minute, 0.9, v(1, 0, 0)), (2, BASE + 2 * minute, BASE + 3 * minute, 0.9, v(0.9, 0.1, 0)), (3, BASE + 4 * minute, BASE + 5 * minute, 0.1, v(0, 1, 0)), (4, BASE + timedelta(hours=3), BASE + timedelta(hours=4), 0.9, v(1, 0, 0)), (5, BASE + timedelta(hours=20), BASE + timedelta(hours=21), 0.9, v(0, 0, 1))]
    df = spark.createDataFrame(rows, "session_id long, start timestamp_ntz, end timestamp_ntz, quality double, embedding array<double>")
    staff = spark.createDataFrame([(50, v(0, 0, 1))], "person_id long, embedding array<double>")
    out = {r.session_id: (r.outcome, r.person) for r in identity.replay(df, staff).collect()}
    assert out == {1: ("created", "new-1"), 2: ("attached", "new-1"), 3: ("left", None), 4: ("created", "new-4"), 5: ("left", None)}


def test_snapshots_and_listing(spark, tmp_path):
    root = f"{tmp_path}/table"
    write_snapshot(spark.range(3), root)
    write_snapshot(read_snapshot(spark, root).filter("id > 0"), root)
    assert sorted(r.id for r in read_snapshot(spark, root).collect()) == [1, 2]
    assert list_objects(spark, root).filter("path LIKE '%.parquet'").count() >= 2


def test_spacing_depends_on_what_was_kept(spark):
    df = spark.createDataFrame([(1, BASE + timedelta(seconds=s)) for s in (0, 20, 31, 40, 62)], "k int, ts timestamp_ntz")
    assert [(r.ts - BASE).seconds for r in spacing.spaced(df, ["k"], "ts", 30).orderBy("ts").collect()] == [0, 31, 62]
    assert DEFAULTS.cooldown_s == 30


def test_lsh_finds_nine_of_ten_neighbours(spark):
    from storepulse.operators import knn

    random = np.random.default_rng(11)
    centres = np.repeat(random.standard_normal((40, 64)), 10, axis=0)
    rows = [(i, i // 10, (c + 0.3 * random.standard_normal(64)).tolist()) for i, c in enumerate(centres)]
    gallery = spark.createDataFrame(rows, "item long, person_id long, embedding array<double>")
    queries = gallery.filter("item % 100 = 0").select(gallery.item.alias("query"), "embedding")
    exact = {(r.query, r.item) for r in knn.nearest(queries, gallery, 5, 0.6).collect()}
    found = {(r.query, r.item) for r in knn.nearest_lsh(queries, gallery, 5, 0.6).collect()}
    assert len(exact) == 20 and len(exact & found) >= 0.9 * len(exact)


def random_gallery(spark, seed, persons=4, n=80, width=4):
    random = np.random.default_rng(seed)
    rows = [(i, int(random.integers(persons)), BASE + timedelta(seconds=int(random.integers(40))), int(random.integers(100)) / 100, f"crop {random.integers(30)}", random.standard_normal(width).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "item long, person_id long, captured_at timestamp_ntz, score double, crop string, embedding array<double>")


def cosine(a, b):
    return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


def by_person(rows):
    for p in sorted({r[1] for r in rows}):
        yield p, sorted((r for r in rows if r[1] == p), key=lambda r: (r[2], r[0]))


@pytest.mark.parametrize("seed", [1, 2])
def test_admitted_faces_by_brute_force(spark, seed):
    rows, df = random_gallery(spark, seed)
    t, want = replace(DEFAULTS, face_contamination=-0.5), set()
    for p, mine in by_person(rows):
        shown: dict = {}  # crop -> row
        for r in mine:
            if r[4] in shown:
                shown[r[4]] = max(shown[r[4]], r, key=lambda x: x[3])
            elif all(cosine(r[5], k[5]) >= t.face_contamination for k in shown.values()):
                shown[r[4]] = r
            shown = {k[4]: k for k in sorted(shown.values(), key=lambda k: (-k[3], k[0]))[:5]}
        want |= {(p, k[0]) for k in shown.values()}
    faces = df.withColumnsRenamed({"item": "face_id", "score": "face_score", "crop": "face_crop_path"})
    assert {tuple(r) for r in identity.admit_faces(faces, t).collect()} == want
    assert identity.admit_faces(faces.limit(0), t).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_admitted_bodies_by_brute_force(spark, seed):
    rows, df = random_gallery(spark, seed)
    t, want = replace(DEFAULTS, body_contamination=-0.1), set()
    for p, mine in by_person(rows):
        taken: list = []
        for r in mine:
            if len(taken) < 3 or np.median([cosine(r[5], k[5]) for k in taken[-10:]]) >= t.body_contamination:
                taken.append(r)
        want |= {(p, k[0]) for k in sorted(taken, key=lambda k: (-k[3], k[0]))[:10]}
    assert {tuple(r) for r in identity.admit_bodies(df.withColumnsRenamed({"item": "body_id", "score": "crop_quality"}), t).collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_track_faces_by_brute_force(spark, seed):
    rows, df = random_gallery(spark, seed)
    t, want = replace(DEFAULTS, face_duplicate=0.9, face_contamination=0.3), set()
    for p, mine in by_person(rows):
        stay: list = []
        for r in mine:
            near = [cosine(r[5], k[5]) for k in stay]
            if not any(x > 0.9 for x in near) and (len(stay) < 2 or any(x >= 0.3 for x in near)):
                stay.append(r)
        want |= {(p, k[0]) for k in stay}
    assert {tuple(r) for r in identity.track_faces(df.withColumnsRenamed({"item": "face_id", "person_id": "track"}), t).collect()} == want


@pytest.mark.parametrize("duplicate", [None, 0.8])
def test_absorbed_by_brute_force(spark, duplicate):
    rows, df = random_gallery(spark, 3, persons=6, n=120)
    named = {0: 2, 1: 2, 2: 2, 3: 3, 4: 3}  # person 5 is in no cluster
    merges = spark.createDataFrame(list(named.items()), "person_id long, winner long")
    want = set()
    for winner in (2, 3):
        cluster = [r for r in rows if r[1] == winner]
        for loser in sorted(p for p, w in named.items() if w == winner and p != winner):
            before = len(cluster)
            for r in sorted((r for r in rows if r[1] == loser), key=lambda r: (-r[3], r[0])):
                near = [cosine(r[5], k[5]) for k in cluster]
                if np.median(near) >= 0.0 and (duplicate is None or max(near) <= duplicate):
                    cluster.append(r)
            if len(cluster) > before:  # pruned loser by loser
                cluster = sorted(cluster, key=lambda k: (-k[3], k[0]))[:25]
        want |= {(winner, k[0]) for k in sorted(cluster, key=lambda k: (-k[3], k[0]))[:25]}
    assert {tuple(r) for r in maintenance.absorbed(df, merges, "item", "score", 25, 0.0, duplicate).collect()} == want


def test_mixed_tracks_name_each_reason(spark):
    at = lambda s: BASE + timedelta(seconds=s)
    rows = [(1, 1, 7, at(0), at(100), "M"), (2, 1, 7, at(50), at(80), "M"), (3, 1, 7, at(200), at(220), "F"), (4, 1, 7, at(300), at(360), "M"), (5, 1, 7, at(400), at(460), None), (6, 1, 8, at(50), at(80), "F"), (7, 1, None, at(0), at(500), "F")]
    sessions = spark.createDataFrame([(*r[:5], r[4], r[5]) for r in rows], "session_id long, camera_id int, person_id long, started_at timestamp_ntz, ended_at timestamp_ntz, last_seen_at timestamp_ntz, gender string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [0.9, 0.1]), (6, [0.0, 1.0])], "session_id long, embedding array<double>")
    faces = spark.createDataFrame([(i, 7, [1.0, 0.0]) for i in range(3)] + [(9, 8, [0.0, 1.0])], "face_id long, person_id long, embedding array<double>")
    out = {(r.session_id, r.reason) for r in maintenance.mixed_tracks(sessions, vectors, faces).collect()}
    assert out == {(2, "overlap"), (3, "gender"), (4, "face")}


def test_dashboard_holds_the_reports(spark, sf_dir):
    """The reports have SQL twins; the dashboard must hold them as they are."""
    p = Probes(spark, sf_dir)
    week = ("2024-01-10 00:00:00", "2024-01-17 00:00:00")
    row = reports.dashboard(p.persons, p.sessions, p.events, p.billing, p.cameras, *week).first()
    want = {
        "visitors": reports.visitors_by_slot(p.sessions, p.persons, *week, "day"), "entry_exit": reports.entry_exit(p.events, *week, "day"), "demographics": reports.demographics(p.persons, p.sessions, p.billing, *week),
        "genders": reports.gender_by_slot(p.sessions, p.persons, *week), "purchases": reports.purchases_by_slot(p.billing, p.persons, *week, "day"), "cameras": reports.persons_by_camera(p.sessions, p.persons, p.cameras, "started_at", *week),
    }
    assert tuple(row.summary) == tuple(reports.dashboard_summary(p.persons, p.sessions, p.events, p.billing, *week).first())
    for name, df in want.items():
        assert row[name] and sorted(map(str, map(tuple, row[name]))) == sorted(str(tuple(r)) for r in df.collect()), name


def test_rules_of_a_stream(spark, tmp_path):
    """One track on a 100 x 100 frame, a frame a second; x and y are the centre."""
    zones = spark.createDataFrame([(1, 1, True, "polygon", '{"points": [[0, 0], [40, 0], [40, 100], [0, 100]]}'), (2, 1, True, "line", '{"points": [[0, 50], [100, 50]]}')], "zone_id int, camera_id int, is_active boolean, shape string, polygon string")
    kinds = [(1, "line_crossing", 2, 1, 5, None), (2, "zone_dwell", 1, None, 30, 4), (3, "billing_interaction", 1, 1, 30, 2), (4, "possible_purchase", 1, 1, 2, 3), (5, "restricted_zone", 1, 1, 4, None), (6, "restricted_zone", 1, 9, 4, None)]
    rules = spark.createDataFrame([(*k, True) for k in kinds] + [(7, "restricted_zone", 1, 1, 1, None, False)], "rule_id int, rule_type string, zone_id int, camera_id int, cooldown_seconds int, dwell_threshold_seconds int, is_enabled boolean")
    # in the zone from 2 to 6; over the line at 1, 6, 10 (forward) and 3, 8, 12 (backward), of which 3, 8 and 10 fall within the cooldown
    path = [(80, 30), (80, 70), (20, 70), (20, 30), (20, 30), (20, 30), (20, 70), (80, 70), (80, 30), (80, 30), (80, 70), (80, 70), (80, 30)]
    box = lambda x, y: (x - 5.0, y - 5.0, x + 5.0, y + 5.0)
    rows = [(1, 1, BASE + timedelta(seconds=i), box(*xy), 0.9, 100, 100) for i, xy in enumerate(path)]
    df = spark.createDataFrame(rows, DETECTIONS.replace("timestamp", "timestamp_ntz")).withColumn("frame_ts", F.col("frame_ts").cast("timestamp"))
    write_in_slices(df, f"{tmp_path}/in", "frame_ts", 3)
    end_of_detections(spark, f"{tmp_path}/in")
    events = runs.to_table(tracks.track_events(detections_stream(spark, f"{tmp_path}/in"), zones, tracks.rule_list(rules, zones)))
    out = {(r.rule_id, r.event_type, (r.at - BASE).seconds) for r in events.filter("rule_id IS NOT NULL").select("*", F.col("occurred_at").cast("timestamp_ntz").alias("at")).collect()}
    assert out == {(1, "line_crossing_forward", 1), (1, "line_crossing_forward", 6), (1, "line_crossing_backward", 12), (2, "zone_dwell_rule", 6), (3, "billing_interaction", 4), (4, "possible_purchase", 5), (5, "restricted_zone", 2), (5, "restricted_zone", 6)}


def test_galleries_grow_over_a_restart(spark, tmp_path):
    """Windows 1 and 2 make persons; 3, 4 and 5 arrive after a stop: 3 is the person of 1, 4 too poor to be anyone, 5 a known person."""
    schema = "query long, camera_id int, start timestamp_ntz, end timestamp_ntz, embedding array<double>, body array<double>, face_score double, face_crop_path string, good_faces int, quality double"
    axis = lambda i, j=None: [1.0 if k == i else 0.3 if k == j else 0.0 for k in range(8)]
    row = lambda q, at, face, body, score: (q, q, BASE + timedelta(seconds=at), BASE + timedelta(seconds=at + 5), face, body, score, f"crop {q}", 2, score)
    first = [row(1, 0, axis(0), axis(1), 0.9), row(2, 10, axis(2), axis(3), 0.9)]
    later = [row(3, 20, axis(0, 7), axis(1, 7), 0.8), row(4, 30, axis(4), axis(5), 0.1), row(5, 40, axis(6, 7), axis(7), 0.9)]
    persons = spark.createDataFrame([(77, BASE, False)], "person_id long, last_seen_at timestamp_ntz, is_staff boolean")
    faces = spark.createDataFrame([(77, 900, axis(6), 0.9, "old", BASE)], identities.FACES)
    none = spark.createDataFrame([], identities.BODIES)
    sessions = spark.createDataFrame([], NO_SESSIONS)

    def run():
        stream = rows_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
        return {r.query: (r.outcome, r.person_id) for r in identities.live_identities(stream, persons, faces, none, sessions, root=f"{tmp_path}/state", progress=f"{tmp_path}/progress").collect()}

    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    before = run()
    assert {q: o for q, (o, _) in before.items()} == {1: "created", 2: "created"} and before[1][1] != before[2][1]
    spark.createDataFrame(later, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    after = run()
    assert after == {**before, 3: ("matched", before[1][1]), 4: ("left", None), 5: ("matched", 77)}
    grown = {(r.person_id, r.face_id) for r in spark.read.parquet(f"{tmp_path}/state/faces").collect()}
    assert grown == {(before[1][1], 1), (before[2][1], 2), (before[1][1], 3), (77, 5)}


def test_ids_over_two_to_the_53_stay_exact(spark):
    from storepulse.operators import knn

    big = (1 << 62) + 1
    gallery = spark.createDataFrame([(big, big + 2, [1.0, 0.0]), (big + 1, None, [1.0, 0.1])], "item long, person_id long, embedding array<double>")
    queries = spark.createDataFrame([(big + 3, [1.0, 0.0])], "query long, embedding array<double>")
    assert [(r.query, r.item, r.person_id) for r in knn.nearest(queries, gallery, 2).orderBy("rank").collect()] == [(big + 3, big, big + 2), (big + 3, big + 1, None)]
    staff = spark.createDataFrame([(big + 2, [1.0, 0.0])], "person_id long, embedding array<double>")
    assert [r.session_id for r in identity.staff_scores(queries.withColumnRenamed("query", "session_id"), staff).collect()] == [big + 3]
