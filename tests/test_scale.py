"""Operators whose work is dealt: the sweep of intervals, pruned nearest neighbours, running medians, first-come sets; each by brute force."""

import glob
import os
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from storepulse.operators import detections as D
from storepulse.operators import folds
from storepulse.operators import identity as I2
from storepulse.operators import intervals as I
from storepulse.operators import knn
from storepulse.operators import maintenance as M
from storepulse.operators import repair as B
from storepulse.operators import spacing
from storepulse.thresholds import DEFAULTS

SESSIONS = "session_id bigint, camera_id int, person_id bigint, started_at timestamp_ntz, ended_at timestamp_ntz, last_seen_at timestamp_ntz"
WHEN = "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, {})"


def session_table(spark, rows):
    """(session, camera, person, start, end) in seconds."""
    df = spark.createDataFrame(rows, "session_id bigint, camera_id int, person_id bigint, s int, e int")
    at = lambda c: F.expr(f"CASE WHEN {c} IS NOT NULL THEN {WHEN.format(c)} END")
    return df.select("session_id", "camera_id", "person_id", at("s").alias("started_at"), at("e").alias("ended_at"), at("e").alias("last_seen_at"))


def hot_rows(n, seed):
    """A third of the sessions start in one hour, a tenth of all at one second; some end before they start or last for nothing."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = 5000 if i % 10 == 0 else rng.randrange(3600, 7200) if i % 3 == 0 else rng.randrange(0, 400_000)
        rows.append((i, rng.randrange(4), rng.choice([None, *range(12)]), s, s + rng.choice([0, -20, 5, 600, 600, 30_000 if i % 50 == 0 else 60])))
    return [*rows, (n, 1, 3, None, 5), (n + 1, 1, 3, 5, None)]


@pytest.mark.parametrize("most", [37, 100_000])
def test_the_sweep_finds_every_pair_once(spark, most):
    rows = hot_rows(700, 2)
    good = [r for r in rows if None not in r]
    overlaps, near = {}, set()
    for x in good:
        for y in good:
            if x[2] < y[2]:
                if x[1] != y[1] and x[3] < y[4] and y[3] < x[4]:
                    overlaps[x[2], y[2]] = overlaps.get((x[2], y[2]), 0) + 1
                if x[3] - 90 <= y[4] and y[3] <= x[4] + 90:
                    near.add((x[2], y[2]))
    table = session_table(spark, rows)
    assert {(r.person_a, r.person_b): r.overlaps for r in I.concurrent_persons(table, most).collect()} == overlaps
    assert {tuple(r) for r in I.persons_within(table, 90.0, most).collect()} == near
    assert I.concurrent_persons(table.filter("false"), most).count() == 0


def test_no_task_of_the_sweep_takes_a_share_of_the_rows(spark):
    rows = spark.createDataFrame([(i, i, 0, s * 1_000_000, e * 1_000_000) for i, (_, _, _, s, e) in enumerate(r for r in hot_rows(3000, 5) if None not in r)], "id bigint, person bigint, camera bigint, s bigint, e bigint")
    dealt = I.dealt_for_sweep(rows, 100).groupBy("task").count().agg(F.max("count")).first()[0]
    assert dealt <= 3 * 100  # parts are by hash, so a little over twice 100


def plain_nearest(queries, gallery, k, least, other_person):
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-300)
    out = set()
    for q, person, v in queries:
        near = [(-round(float(unit(v) @ unit(w)), 12), i, p) for i, p, w in gallery if not (other_person and person == p)]
        out |= {(q, i, p, rank + 1) for rank, (s, i, p) in enumerate(sorted(near)[:k]) if -s >= least}
    return out


@pytest.mark.parametrize("other_person", [False, True])
def test_nearest_by_brute_force(spark, other_person):
    """Clusters, equal vectors, a third of the rows alike, vectors without length and without person."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(8, 6))
    vectors = [(centres[i % 8] + 0.15 * rng.normal(size=6)).tolist() for i in range(240)] + [[1.0, 2.0, 0.0, 0.0, 1.0, 0.0]] * 120 + [[0.0] * 6] * 3
    gallery = [(i, i % 17 if i % 5 else None, v) for i, v in enumerate(vectors)]
    queries = [(i, gallery[i][1], vectors[i]) for i in range(0, len(vectors), 3)]
    q = spark.createDataFrame([*queries, (10_000, 1, None)], "query bigint, person_id bigint, embedding array<double>")
    g = spark.createDataFrame([*gallery, (10_001, 1, None)], "item bigint, person_id bigint, embedding array<double>")
    for least in (-1.0, 0.0, 0.7):
        want = {(a, b, r) for a, b, _, r in plain_nearest(queries, [(i, p, v) for i, p, v in gallery], 4, least, other_person and True)}
        if other_person:  # rows without a person are nobody's
            want = {(a, b, r) for a, b, _, r in plain_nearest([(i, p if p is not None else -1, v) for i, p, v in queries], gallery, 4, least, True)}
        got = knn.nearest(q, g, 4, least, other_person, block=32).collect()
        assert {(r["query"], r["item"], r["rank"]) for r in got} == want
        assert all(r.person_id == gallery[r["item"]][1] for r in got)
    assert knn.nearest(q.filter("false"), g, 4, block=32).count() == 0 and knn.nearest(q, g.filter("false"), 4).count() == 0


def test_nearest_skips_far_cells(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    rows = [(i, i, (centres[i % 40] + 0.02 * rng.normal(size=16)).tolist()) for i in range(4000)]
    g = spark.createDataFrame(rows, "item bigint, person_id bigint, embedding array<double>")
    q = g.filter("item % 4 = 0").select(F.col("item").alias("query"), "person_id", "embedding")
    done = spark.sparkContext.accumulator(0)
    got = knn.nearest(q, g, 5, 0.5, block=64, products=done).collect()
    assert len(got) == 5000 and all(r["query"] % 40 == r["item"] % 40 for r in got)
    assert done.value < 1000 * 4000 / 5


def plain_contaminated(vectors, least, stop):
    x = np.array(vectors, dtype=float)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    sim, left, gone = x @ x.T, list(range(len(x))), []
    while len(left) >= max(stop, 2):
        medians = [round(float(np.median([sim[i, j] for j in left if j != i])), 9) for i in left]
        worst = int(np.argmin(medians))
        if medians[worst] >= least:
            break
        gone.append(left.pop(worst))
    return gone


def test_running_medians_by_brute_force():
    rng = np.random.default_rng(1)
    for turn in range(60):
        n = int(rng.integers(2, 40))
        x = rng.integers(-2, 3, size=(n, 3)).astype(float) if turn % 2 else rng.normal(size=(n, 5))  # ties, and none
        for least, stop in ((0.0, 2), (2.0, 2), (0.3, 3)):
            medians, gone = M.Medians(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), 7), []
            while medians.left >= max(stop, 2) and medians.values().min() < least:
                gone.append(int(np.argmin(medians.values())))
                medians.remove(gone[-1])
            assert gone == plain_contaminated(x, least, stop)


def test_contaminated_by_brute_force(spark):
    rng = np.random.default_rng(6)
    vectors = rng.integers(-2, 3, size=(120, 3)).astype(float)
    rows = [(i % 7 if i < 60 else 7, i, float(i % 4), vectors[i].tolist()) for i in range(120)]
    got = M.contaminated(spark.createDataFrame([*rows, (7, 999, 1.0, None)], "person_id bigint, face_id bigint, score double, embedding array<double>"), "face_id", "score", 0.1, 3)
    want = set()
    for person in range(8):
        own = sorted((r for r in rows if r[0] == person), key=lambda r: (-r[2], r[1]))
        want |= {(person, own[i][1]) for i in plain_contaminated([r[3] for r in own], 0.1, 3)}
    assert {tuple(r) for r in got.collect()} == want and want
    assert M.contaminated(spark.createDataFrame([(1, 1, 1.0, [1.0])], "person_id bigint, face_id bigint, score double, embedding array<double>"), "face_id", "score", 2.0, 1).count() == 0


def test_contamination_of_a_large_gallery_is_bounded():
    n = 3000
    medians = M.Medians(np.random.default_rng(0).normal(size=(n, 8)))
    assert medians.order.nbytes + medians.rank.nbytes == 4 * n * n  # so 1.6 GB for 20,000 rows


@pytest.mark.parametrize("most", [0, 50_000])
def test_overlap_losers_by_brute_force(spark, most):
    """A third of the sessions are one person's on one camera; some are equally long; every round is taken (most = 0), or none."""
    rng = random.Random(8)
    rows = []
    for i in range(240):
        s = rng.randrange(0, 2000)
        rows.append((i, 1 if i % 3 == 0 else rng.randrange(3), 5 if i % 3 == 0 else rng.choice([None, 1, 2]), s, s + rng.choice([10, 10, 60, 200])))
    kept, lost = {}, set()
    for session, camera, person, s, e in sorted(rows, key=lambda r: (-(r[4] - r[3]), r[3], r[0])):
        if person is None:
            continue
        own = kept.setdefault((camera, person), [])
        if any(min(e, b) - max(s, a) >= 1 for a, b in own):
            lost.add(session)
        else:
            own.append((s, e))
    got = M.overlap_losers(session_table(spark, rows), 1.0, most).collect()
    assert sorted(r.session_id for r in got) == sorted(lost) and lost
    assert M.overlap_losers(session_table(spark, rows).filter("person_id IS NULL")).count() == 0


@pytest.mark.parametrize("most", [16, 100_000])
def test_spacing_by_brute_force(spark, most):
    """One key has most rows, in bursts and silences; times are shared by rows; null keys and null times."""
    rng = random.Random(12)
    rows, t = [], 0
    for i in range(900):
        t += rng.choice([0, 0, 1, 1, 2, 5, 300 if i % 90 == 0 else 1])
        rows.append((7 if i % 4 else rng.choice([None, 1, 2]), t, rng.randrange(1000)))
    rows += [(7, None, 1), (9, 50, 3)]
    df = spark.createDataFrame(rows, "k int, t int, other int").select("k", F.expr(f"CASE WHEN t IS NOT NULL THEN {WHEN.format('t')} END").alias("ts"), "other", "t")
    want = []
    for key in {r[0] for r in rows}:
        last = None
        for time, other in sorted((r[1], r[2]) for r in rows if r[0] == key and r[1] is not None):
            if last is None or time - last >= 7:
                want.append((key, time, other))
                last = time
    got = spacing.spaced(df, ["k"], "ts", 7.0, most)
    assert sorted(map(str, map(tuple, got.select("k", "t", "other").collect()))) == sorted(map(str, want))
    assert spacing.spaced(df.filter("false"), ["k"], "ts", 7.0, most).count() == 0


def test_stitching_takes_the_reasons_in_turn(spark):
    """Face 0.40 accepts, under 0.25 rejects, body 0.80 accepts, gaps 0.03 and 0.05, staff from 0.70."""
    scored = [
        (1, 1, True, 0.5, 0.1, 0.1), (1, 2, True, 0.3, 0.9, 0.1),  # a face over a body
        (2, 1, True, 0.5, None, None), (2, 2, True, 0.48, None, None),  # two faces too close
        (3, 1, False, None, 0.9, 0.2), (3, 2, False, None, 0.87, 0.2),  # two bodies too close
        (4, 1, False, None, 0.9, 0.2), (4, 2, False, None, 0.7, 0.2),
        (5, 1, True, 0.2, 0.95, 0.2),  # the face rejects
        (6, 1, True, None, 0.95, 0.2),  # a face, but the person has none: the body alone does not do
        (7, 1, True, 0.9, 0.9, 0.7),  # staff
        (8, 1, True, 0.3, 0.9, 0.1), (8, 2, True, 0.2, 0.99, 0.1),
        (9, 1, True, None, None, None),
    ]
    df = spark.createDataFrame(scored, "orphan bigint, person_id bigint, has_face boolean, face double, body double, staff_body double")
    got = {r.orphan: (r.person_id, r.how, r.reason) for r in B.stitch(df).collect()}
    assert got == {
        1: (1, "face", "stitched"), 2: (1, "face", "ambiguous"), 3: (1, "body", "ambiguous"), 4: (1, "body", "stitched"), 5: (None, None, "no_match"), 6: (None, None, "no_match"),
        7: (None, None, "staff"), 8: (1, "body_face_ok", "stitched"), 9: (None, None, "no_match"),
    }


def test_medians_to_all_in_blocks(spark):
    rng = np.random.default_rng(2)
    q, g = rng.normal(size=(30, 4)), rng.normal(size=(41, 4))
    table = lambda x, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], f"{name} bigint, embedding array<double>")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    for rows in (41, 40):
        want = np.median(unit(q) @ unit(g[:rows]).T, axis=1)
        got = {r["query"]: r for r in knn.median_to_all(table(q, "query"), table(g[:rows], "item"), block=7).collect()}
        assert sorted(got) == list(range(30)) and all(got[i].n == rows and abs(got[i].median - want[i]) < 1e-9 for i in range(30))
    assert knn.median_to_all(table(q, "query"), table(g, "item").filter("false")).count() == 0


def plain_replay(rows, staff, t):
    """rows (session, start, end, quality, vector); staff: person to vectors."""
    unit = lambda v: np.array(v, dtype=float) / max(np.linalg.norm(v), 1e-12)
    people, out = {}, {}
    for session, start, end, quality, vector in sorted(rows, key=lambda r: (r[1], r[0])):
        v = unit(vector)
        near = max((float(np.median([unit(w) @ v for w in vs])) for vs in staff.values()), default=-1.0)
        live = sorted((-float(np.median([w @ v for w in vs])), k) for k, (seen, vs) in people.items() if start - seen <= 60 * t.recent_minutes)
        best = -live[0][0] if live else -1.0
        person, outcome = None, "left"
        if live and best >= t.body_recent and (len(live) < 2 or live[1][0] - live[0][0] >= t.body_ambiguity):
            person, outcome = live[0][1], "attached"
        elif quality >= t.create_body_quality and best < t.create_body_nearest and near < t.create_body_staff:
            person, outcome = f"new-{session}", "created"
        if person is not None:
            seen, vs = people.get(person, (end, []))
            people[person] = (max(seen, end), [*vs, v][-t.most_bodies :])
        out[session] = (person, outcome)
    return out


def test_replay_of_a_day_without_silence(spark, tmp_path):
    """300 sessions a minute or two apart are one island; then a silence and 20 more. In slices, it is stopped and goes on."""
    rng, t = np.random.default_rng(5), replace(DEFAULTS, body_recent=0.6, create_body_nearest=0.5, create_body_staff=0.97, most_bodies=4)
    centres, rows, at = rng.normal(size=(12, 6)), [], 0
    for i in range(320):
        at += int(rng.integers(20, 110)) + (4000 if i == 300 else 0)
        rows.append((i, at, at + int(rng.integers(5, 90)), float(rng.random()), (centres[(i // 12 + int(rng.integers(0, 3))) % 12] + 0.2 * rng.normal(size=6)).tolist()))
    staff = {1: [centres[0].tolist()], 2: [centres[5].tolist(), centres[6].tolist()]}
    df = spark.createDataFrame(rows, "session_id bigint, s int, e int, quality double, embedding array<double>").select("session_id", F.expr(WHEN.format("s")).alias("start"), F.expr(WHEN.format("e")).alias("end"), "quality", "embedding")
    bodies = spark.createDataFrame([(p, v) for p, vs in staff.items() for v in vs], "person_id bigint, embedding array<double>")
    want = plain_replay(rows, staff, t)
    assert {o for _, o in want.values()} == {"attached", "created", "left"}
    answer = lambda df: {r.session_id: (r.person, r.outcome) for r in df.collect()}
    assert answer(I2.replay(df, bodies, t)) == want
    root = f"{tmp_path}/replay"
    assert answer(I2.replay(df, bodies, t, 40, root)) == want
    slices = sorted(glob.glob(f"{root}/island=*/slice=*"))
    assert len(slices) >= 7
    before = {s: os.path.getmtime(f"{s}/_SUCCESS") for s in slices}
    for s in slices:
        if int(s.rsplit("=", 1)[1]) >= 4:  # as if it had stopped within the fifth slice
            os.remove(f"{s}/_SUCCESS")
    assert answer(I2.replay(df, bodies, t, 40, root)) == want
    assert all((os.path.getmtime(f"{s}/_SUCCESS") == before[s]) == (int(s.rsplit("=", 1)[1]) < 4) for s in slices)


def test_assignment_of_faces_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(frame, face, track, round(rng.random(), 2)) for frame in range(60) for face in range(4) for track in range(4) if rng.random() < 0.6]
    df = spark.createDataFrame([(1, f, a, b, s) for f, a, b, s in rows], "camera_id int, frame int, face int, track int, score double").withColumn("frame_ts", F.expr(WHEN.format("frame"))).drop("frame")
    want = set()
    for frame in range(60):
        own = [r for r in rows if r[0] == frame]
        clear = set()
        for face in range(4):
            scores = sorted((r[3] for r in own if r[1] == face), reverse=True)
            if scores and (len(scores) < 2 or scores[0] == 0 or scores[1] / scores[0] < DEFAULTS.assign_ambiguity):
                clear.add(face)
        faces, taken = set(), set()
        for _, face, track, score in sorted((r for r in own if r[1] in clear), key=lambda r: (-r[3], r[1], r[2])):
            if face not in faces and track not in taken:
                faces.add(face), taken.add(track), want.add((frame, face, track, score))
    got = D.assign_faces(df.select("camera_id", "frame_ts", "face", "track", "score"))
    assert {(r.s, r.face, r.track, r.score) for r in got.withColumn("s", F.second("frame_ts")).collect()} == want and want


def test_mixed_tracks_by_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, rng.randrange(2), rng.choice([None, 1, 2, 3]), s := rng.randrange(0, 3000), s + rng.choice([20, 60, 90]), rng.choice(["M", "F", None])) for i in range(150)]
    vectors = {i: [rng.gauss(0, 1) for _ in range(3)] for i in range(0, 150, 2)}
    faces = [(p, [rng.gauss(0, 1) for _ in range(3)]) for p in (1, 2, 3, 3, 3) for _ in range(2)]
    names = spark.createDataFrame([(r[0], r[5]) for r in rows], "session_id bigint, gender string")
    sessions = session_table(spark, [r[:5] for r in rows]).join(names, "session_id")
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    kept, want = {}, set()
    for session, camera, person, s, e, _ in sorted(rows, key=lambda r: (-(r[4] - r[3]), r[3], r[0])):
        own = kept.setdefault((camera, person), []) if person is not None else []
        if any(min(e, b) - max(s, a) >= 1 for a, b in own):
            want.add((session, "overlap"))
        else:
            own.append((s, e))
    rest = [r for r in rows if r[2] is not None and (r[0], "overlap") not in want]
    for person in (1, 2, 3):
        time = {g: sum(r[4] - r[3] for r in rest if r[2] == person and r[5] == g) for g in "MF"}
        major = "M" if time["M"] > time["F"] else "F" if time["F"] > time["M"] else None
        for session, _, _, _, _, gender in (r for r in rest if r[2] == person):
            if gender and major and gender != major:
                want.add((session, "gender"))
            elif session in vectors and np.median([unit(vectors[session]) @ unit(f) for p, f in faces if p == person]) < 0.1:
                want.add((session, "face"))
    got = M.mixed_tracks(sessions, spark.createDataFrame(list(vectors.items()), "session_id bigint, embedding array<double>"), spark.createDataFrame([(i, *f) for i, f in enumerate(faces)], "face_id bigint, person_id bigint, embedding array<double>"), replace(DEFAULTS, face_contamination=0.1))
    assert {(r.session_id, r.reason) for r in got.collect()} == want and {r for _, r in want} == {"overlap", "gender", "face"}


def test_folds_see_whole_groups_after_a_join_on_their_keys(spark):
    """The join is planned as a sorted one and becomes a broadcast as it runs, which parts the rows of a key unless the fold deals them anew."""
    rows = spark.range(0, 4_000_000, 1, 7).filter("id % 100 = 0").selectExpr("id DIV 100 % 50 AS k", "id DIV 100 AS id")
    small = spark.range(4_000_000).filter("id % 80000 = 0").selectExpr("id DIV 80000 AS k", "id AS x")
    joined = rows.join(small, "k", "left")
    counted = folds.fold_in_order(joined, ["k"], ["id"], lambda: [0], lambda state, row: state.__setitem__(0, state[0] + 1) or (), "k bigint, n bigint", lambda key, state: [(key[0], state[0])])
    first = folds.select_in_order(joined, ["k"], ["id"], lambda columns: [0], ["id"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with tables of many partitions
    try:
        assert sorted(map(tuple, counted.collect())) == [(k, 800) for k in range(50)]
        assert sorted(r.id for r in first.collect()) == list(range(50))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
