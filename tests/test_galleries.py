"""Similarities of galleries, counted similarities and stitching: each by brute force, and without a row for each pair."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storepulse.operators import knn
from storepulse.operators import maintenance as M
from storepulse.operators import repair as B
from tests.test_scale import session_table

unit = lambda x: np.array(x) / max(np.linalg.norm(x), 1e-300)


def no_row_for_each_pair(*_):
    raise AssertionError("a row for each pair")


def test_nearest_cuts_no_row_for_each_cell(spark, monkeypatch):
    """Vectors without structure: every query visits every cell, of which there are 50."""
    rng, sizes, cut = np.random.default_rng(4), [], knn.cut
    monkeypatch.setattr(knn, "cut", lambda df, what="cut": (sizes.append((out := cut(df, what)).count()), out)[1])
    g = spark.createDataFrame([(i, i % 9, v.tolist()) for i, v in enumerate(rng.normal(size=(800, 24)))], "item bigint, person_id bigint, embedding array<double>")
    q = g.filter("item % 4 = 0").select(F.col("item").alias("query"), "person_id", "embedding")
    assert knn.nearest(q, g, 3, block=32).count() == 600
    assert max(sizes) <= 800


@pytest.mark.parametrize("held", [1 << 21, 256])
def test_similarity_to_galleries_by_brute_force(spark, monkeypatch, held):
    """Regions and parts of many sizes; queries of two rows, persons without rows, null and zero vectors."""
    monkeypatch.setattr(knn, "HELD", held, raising=False)
    monkeypatch.setattr(knn, "cosines", no_row_for_each_pair)
    rng = np.random.default_rng(8)
    gallery = [(i % 13, v.tolist()) for i, v in enumerate(rng.normal(size=(150, 5)))] + [(3, [0.0] * 5), (4, None), (20, None)]
    queries = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 5)))] + [(7, [1.0, 2.0, 0.0, 0.0, 1.0]), (41, [0.0] * 5), (42, None)]
    pairs = [(q, p) for q in range(44) for p in (q % 13, q * 5 % 13, 20, 99)]
    want = {}
    for q, p in set(pairs):
        sims = [float(unit(x) @ unit(y)) for i, x in queries if i == q and x for person, y in gallery if person == p and y]
        if sims:
            want[q, p] = (np.median(sims), max(sims), min(sims), len(sims))
    table = lambda rows, names: spark.createDataFrame(rows, f"{names}, embedding array<double>")
    got = knn.similarity_to_galleries(spark.createDataFrame(pairs, "query bigint, person_id bigint"), table(queries, "query bigint"), table(gallery, "person_id bigint")).collect()
    assert len(got) == len(want) and {(r["query"], r.person_id) for r in got} == set(want)
    assert all(np.allclose((r.median, r.best, r.worst, r.n), want[r["query"], r.person_id], atol=1e-11) for r in got)


def test_gallery_pairs_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "cosines", no_row_for_each_pair)
    rng = np.random.default_rng(5)
    gallery = [(i % 11, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 4)))] + [(50, None)]
    pairs = [(a, b) for a in range(12) for b in range(12) if (a + b) % 3 == 0] + [(1, 50)]
    got = knn.gallery_pairs(spark.createDataFrame(pairs, "a bigint, b bigint"), spark.createDataFrame(gallery, "person_id bigint, embedding array<double>")).collect()
    of = lambda p: [unit(v) for person, v in gallery if person == p and v]
    want = {(a, b): [float(x @ y) for x in of(a) for y in of(b)] for a, b in pairs if of(a) and of(b)}
    assert {(r.a, r.b) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        s = want[r.a, r.b]
        assert np.allclose((r.median, r.best, r.worst, r.mean, r.n), (np.median(s), max(s), min(s), np.mean(s), len(s)), atol=1e-11)


def test_the_middle_of_many_products_is_found_in_bins():
    rng = np.random.default_rng(2)
    for turn in range(40):
        n, m = (int(k) for k in rng.integers(1, 30, size=2))
        x, y = (np.array([unit(v) for v in (rng.integers(-1, 2, size=(k, 3)) if turn % 2 else rng.normal(size=(k, 3)))]) for k in (n, m))
        s = x @ y.T
        got = knn._of_all(x, y, most=8, bins=16)
        assert np.allclose(got, (np.median(s), s.max(), s.min(), s.mean(), s.size), atol=1e-11)


@pytest.mark.parametrize("held", [1 << 21, 512])
def test_counted_similarities_by_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(knn, "HELD", held, raising=False)
    rng = np.random.default_rng(3)
    rows = [(i % 3, i, i % 7 if i % 10 else None, v.tolist()) for i, v in enumerate(rng.normal(size=(120, 4)))]
    rows += [(0, 500, 2, rows[0][3]), (0, 501, 2, [0.0] * 4), (0, 502, 2, None), (None, 503, 2, rows[0][3]), (9, 504, 1, rows[0][3])]
    want = {}
    for g, i, p, x in rows:
        for h, j, q, y in rows:
            if g is not None and g == h and i < j and x and y:
                key = ("same" if p is not None and p == q else "different", round(float(unit(x) @ unit(y)), 2) + 0.0)
                want[key] = want.get(key, 0) + 1
    df = spark.createDataFrame(rows, "`group` int, id bigint, person bigint, embedding array<double>")
    assert {(r.kind, round(r.sim, 2)): r.pairs for r in knn.similarity_counts(df, 2).collect()} == want
    assert knn.similarity_counts(df.filter("false")).count() == 0


@pytest.mark.parametrize("gap", [30.0, 5000.0])
def test_stitch_persons_are_those_of_the_candidates(spark, gap):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, 0, 1]), rng.choice([None, None, 1, 2, 3, 4]), s := rng.randrange(0, 40_000), s + rng.choice([0, 20, 600, 9000])) for i in range(300)]
    table, staff = session_table(spark, [*rows, (900, 1, 2, None, 5), (901, 1, None, 5, None)]), spark.createDataFrame([(4,)], "person_id bigint")
    want = {(o, p) for o, c, n, s, e in rows for _, d, p, t, f in rows if n is None and p not in (None, 4) and c is not None and c == d and 0 <= max(t - e, s - f) <= gap}
    assert {tuple(r) for r in B.stitch_persons(table, staff, gap).collect()} == want and want
    assert {tuple(r) for r in B.stitch_candidates(table, staff, gap).select("orphan", "person_id").collect()} == want


def test_merges_leave_out_persons_without_vectors(spark, monkeypatch):
    """Only their sessions are paired: who has no vectors is merged with no one."""
    seen = []
    monkeypatch.setattr(M, "persons_within", lambda sessions, *a, f=M.persons_within: seen.append({r.person_id for r in sessions.select("person_id").distinct().collect()}) or f(sessions, *a))
    sessions = session_table(spark, [(i, i, i, 100 * (i % 3), 100 * (i % 3) + 500) for i in range(30)])
    one = [(1, 0, [1.0, 0.0]), (2, 1, [1.0, 0.01]), (3, 2, [0.0, 1.0])]
    faces = spark.createDataFrame(one, "face_id bigint, person_id bigint, embedding array<double>")
    bodies = spark.createDataFrame(one, "body_id bigint, person_id bigint, embedding array<double>")
    assert {tuple(r) for r in M.recent_merges(sessions, faces, bodies).collect()} == {(0, 1, "face")}
    persons = spark.createDataFrame([(i, i == 1) for i in range(30)], "person_id bigint, is_staff boolean")
    assert {tuple(r) for r in M.staff_fragments(sessions, persons, faces, bodies).collect()} == {(0, 1)}
    assert seen == [{0, 1, 2}, {0, 1, 2}]
