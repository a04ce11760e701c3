"""Matching of probes to persons: tiers of faces and bodies, gates, ambiguity, creation, refinement, admission to galleries.

A batch decides all probes against one snapshot of the galleries; replay() gives the sequential answer."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storepulse.functions import vectors as V
from storepulse.functions.scalars import seconds_between
from storepulse.operators.folds import fold_in_order, unit
from storepulse.operators.intervals import near_pairs, overlap_seconds
from storepulse.operators.knn import best_persons, similarity_to_galleries
from storepulse.operators.scopes import at
from storepulse.plans.lineage import cut, new_path, written
from storepulse.thresholds import DEFAULTS, Thresholds

PROBE_FACES, PROBE_BODIES = 100, 25


def accept_threshold(tier: Column, t: Thresholds = DEFAULTS) -> Column:
    return F.when(tier == "face_recent", t.face_recent).when(tier == "face", t.face_match).when(tier == "body_recent", t.body_recent).when(tier == "body", t.body_match).when(tier == "staff", t.staff_body)


def recently_active(persons: DataFrame, sessions: DataFrame, bodies: DataFrame, as_of, t: Thresholds = DEFAULTS) -> DataFrame:
    """person_id of persons with a session in the last minutes, a body captured in them, or last seen in them."""
    since = at(as_of) - F.expr(f"INTERVAL '{t.recent_minutes}' MINUTE")
    in_session = sessions.filter((F.coalesce("ended_at", "last_seen_at") >= since) & (F.col("started_at") <= at(as_of))).select("person_id")
    in_bodies = bodies.filter(F.col("captured_at").between(since, at(as_of))).select("person_id")
    seen = persons.filter(F.col("last_seen_at").between(since, at(as_of))).select("person_id")
    return in_session.union(in_bodies).union(seen).filter("person_id IS NOT NULL").distinct()


def contradictions(assigned: DataFrame, faces: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """query, person_id, best, contradicted: the best similarity of a probe's face to the gallery of the person it has now."""
    best = similarity_to_galleries(assigned, assigned, faces)
    return best.select("query", "person_id", "best", (F.col("best") < t.face_contradiction).alias("contradicted"))


def cluster_guard(best: Column, median: Column, n: Column, t: Thresholds = DEFAULTS) -> Column:
    """Whether a face match stands against the whole gallery: strict ones with two rows need a median, grey ones with three need another."""
    strict = best >= t.face_match
    return F.when(strict & (n >= 2), median >= t.cluster_median_strict).when(~strict & (n >= t.cluster_pairs), median >= t.cluster_median_grey).otherwise(F.lit(True))


def face_candidates(probes: DataFrame, faces: DataFrame) -> DataFrame:
    """query, person_id, face: each probe's persons among its nearest faces."""
    return best_persons(probes.select("query", "embedding"), faces.select(F.col("face_id").alias("item"), "person_id", "embedding"), 10, PROBE_FACES).select("query", "person_id", F.col("sim").alias("face"))


def body_candidates(probes: DataFrame, bodies: DataFrame, faces: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """query, person_id, median, n, face (best similarity of the probe's face to the person's, null without faces): persons among the nearest bodies with enough bodies."""
    near = cut(best_persons(probes.select("query", F.col("body").alias("embedding")), bodies.select(F.col("body_id").alias("item"), "person_id", "embedding"), 10, PROBE_BODIES), "near")
    medians = similarity_to_galleries(near, probes.select("query", F.col("body").alias("embedding")), bodies).filter(F.col("n") >= t.least_bodies)
    own = similarity_to_galleries(medians, probes.select("query", "embedding"), faces).select("query", "person_id", F.col("best").alias("face"))
    return medians.select("query", "person_id", "median", "n").join(own, ["query", "person_id"], "left")


def ranked_bodies(candidates: DataFrame, least: float, exclusion: float, gap: float) -> DataFrame:
    """query, person_id, score, ambiguous: the best body candidate that its faces do not exclude; ambiguous if the second is too close."""
    w = Window.partitionBy("query").orderBy(F.desc("median"), "person_id")
    good = candidates.filter((F.col("median") >= least) & F.coalesce(F.col("face") >= exclusion, F.lit(True)))
    ranked = good.withColumn("rank", F.row_number().over(w)).withColumn("second", F.lead("median").over(w)).filter("rank = 1")
    return ranked.select("query", "person_id", F.col("median").alias("score"), F.coalesce(F.col("median") - F.col("second") < gap, F.lit(False)).alias("ambiguous"))


def match_identities(probes: DataFrame, persons: DataFrame, faces: DataFrame, bodies: DataFrame, sessions: DataFrame, as_of, t: Thresholds = DEFAULTS) -> DataFrame:
    """query, person_id, tier, score, accepted, reason: one row per probe (query, camera_id, start, end, embedding, body[, current_person]).

    In turn: a strict face, a face of a recently active person, a body of a recently active person, any body, a staff body with a face. The
    first tier that has a candidate decides. A face match must stand against its gallery; an ambiguous body gives no person; a person seen
    at the same time on the same camera blocks the match. A probe whose face contradicts the person it has now never matches that person again."""
    recent = recently_active(persons, sessions, bodies, as_of, t).withColumn("recent", F.lit(True))
    near = face_candidates(probes, faces)
    contradicted = None
    if "current_person" in probes.columns:
        assigned = probes.filter("current_person IS NOT NULL AND embedding IS NOT NULL").select("query", F.col("current_person").alias("person_id"), "embedding")
        contradicted = cut(contradictions(assigned, faces, t).filter("contradicted").select("query", "person_id"), "contradicted")
        near = near.join(contradicted, ["query", "person_id"], "left_anti")
    guard = cut(near, "faces")
    stats = similarity_to_galleries(guard, probes.select("query", "embedding"), faces)
    known = guard.join(stats.select("query", "person_id", "median", "n"), ["query", "person_id"]).join(recent, "person_id", "left")
    known = cut(known.filter(cluster_guard(F.col("face"), F.col("median"), F.col("n"), t)), "known")
    strict = known.filter(F.col("face") >= t.face_match).select("query", "person_id", F.lit("face").alias("tier"), F.lit(1).alias("turn"), F.col("face").alias("score"), F.lit(False).alias("ambiguous"))
    grey = known.filter(F.col("recent") & (F.col("face") >= t.face_recent)).select("query", "person_id", F.lit("face_recent").alias("tier"), F.lit(2).alias("turn"), F.col("face").alias("score"), F.lit(False).alias("ambiguous"))
    body = body_candidates(probes, bodies, faces, t)
    body = cut(body if contradicted is None else body.join(contradicted, ["query", "person_id"], "left_anti"), "bodies")
    staff = persons.filter("is_staff").select("person_id")
    tiers = [
        ("body_recent", 3, ranked_bodies(body.join(recent, "person_id", "left_semi"), t.body_recent, t.face_contradiction, t.body_ambiguity)),
        ("body", 4, ranked_bodies(body, t.body_match, t.face_body_exclusion, t.body_ambiguity)),
        ("staff", 5, ranked_bodies(body.join(staff, "person_id", "left_semi").filter(F.coalesce(F.col("face") >= t.staff_face, F.lit(False)) & (F.col("n") >= t.staff_bodies)), t.staff_body, t.staff_face, t.staff_ambiguity)),
    ]
    every = strict.union(grey)
    for name, turn, found in tiers:
        every = every.union(found.select("query", "person_id", F.lit(name), F.lit(turn), "score", "ambiguous"))
    w = Window.partitionBy("query").orderBy("turn", F.desc("score"), "person_id")
    first = cut(every.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank", "turn"), "first")
    blocked = overlap_gate(first.join(probes.select("query", "camera_id", "start", "end"), "query"), sessions, t)
    out = probes.select("query").join(first, "query", "left").join(blocked.withColumn("blocked", F.lit(True)), "query", "left")
    reason = F.when(F.col("tier").isNull(), "no_candidate").when(F.col("ambiguous"), "ambiguous").when(F.col("blocked"), "overlap").otherwise("matched")
    out = out.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "matched")
    return out.select("query", F.when(F.col("accepted"), F.col("person_id")).alias("person_id"), "tier", "score", "accepted", "reason")


def overlap_gate(matches: DataFrame, sessions: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """query of matches (query, person_id, camera_id, start, end) whose person has another session on the camera for overlap_live_s of that time."""
    left = matches.select("query", "person_id", "camera_id", "start", "end")
    right = sessions.join(left.select("person_id").distinct(), "person_id", "left_semi").select("session_id", "person_id", "camera_id", F.col("started_at").alias("start"), F.coalesce("ended_at", "last_seen_at").alias("end"))
    pairs = near_pairs(left, right, ["person_id", "camera_id"]).filter("l.query <> r.session_id")
    over = overlap_seconds(*(F.col(c) for c in ("l.start", "l.end", "r.start", "r.end")))
    return pairs.filter(over >= t.overlap_live_s).select(F.col("l.query").alias("query")).distinct()


def creations(unmatched: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """query, how, person_id (a hash of the query): unmatched probes (query, face_score, good_faces, quality, nearest, nearest_staff) that make a new person.

    A good face seen often enough; else a good body that is near neither a recent person nor staff."""
    by_face = F.coalesce((F.col("face_score") >= t.create_face_score) & (F.col("good_faces") >= t.create_detections), F.lit(False))
    far = F.coalesce(F.col("nearest") < t.create_body_nearest, F.lit(True)) & F.coalesce(F.col("nearest_staff") < t.create_body_staff, F.lit(True))
    by_body = F.coalesce(F.col("quality") >= t.create_body_quality, F.lit(False)) & far
    how = F.when(by_face, "face").when(by_body, "body")
    return unmatched.withColumn("how", how).filter("how IS NOT NULL").select("query", "how", F.sha2(F.concat(F.lit("person|"), F.col("query").cast("string")), 256).alias("person_id"))


def refinement(current: Column, candidate: Column, tier: Column, score: Column, current_score: Column, quality: Column, contradicted: Column, t: Thresholds = DEFAULTS) -> Column:
    """What a tracked session does with a new decision: assign, keep, switch, detach or none."""
    by_face = tier.isin("face", "face_recent")
    return (
        F.when(current.isNull() & candidate.isNotNull(), "assign").when(current.isNull(), "none")
        .when(contradicted & (candidate.isNull() | (candidate == current)), "detach").when(candidate.isNull() | (candidate == current), "keep")
        .when(contradicted | by_face & (score > F.coalesce(current_score, F.lit(-1.0))), "switch").when(~by_face & (quality >= t.switch_quality) & (score > F.coalesce(current_score, F.lit(-1.0))), "switch").otherwise("keep")
    )


def admit_faces(gallery: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """face_id of the rows a person's gallery takes, in order of time: the same crop only if better scored; none whose worst similarity to the
    best few is too low; the best few stay. A fold holds the most_faces rows of the gallery as it stands."""

    def step(kept: list, row: tuple) -> tuple:
        face, vector, score, crop, _ = row
        mine = (score, face, unit(vector), crop)
        same = next((i for i, k in enumerate(kept) if k[3] == crop), None)
        if same is not None:
            if score > kept[same][0]:
                kept[same] = mine
        elif not kept or min(k[2] @ mine[2] for k in kept) >= t.face_contamination:
            kept.append(mine)
        kept.sort(key=lambda k: (-k[0], k[1]))
        del kept[t.most_faces :]
        return ()

    rows = gallery.select("person_id", "face_id", "embedding", "face_score", "face_crop_path", "captured_at")
    return fold_in_order(rows, ["person_id"], ["captured_at", "face_id"], list, step, "person_id bigint, face_id bigint", lambda key, kept: [(key[0], k[1]) for k in kept])


def admit_bodies(gallery: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """body_id of the rows a person's gallery takes, in order of time: with three or more, the median similarity to the latest ten must be high enough.
    A fold holds the latest and the best most_bodies rows."""

    def step(state: tuple, row: tuple) -> tuple:
        latest, best = state
        body, vector, quality, _ = row
        v = unit(vector)
        if len(latest) < 3 or np.median([k @ v for k in latest]) >= t.body_contamination:
            latest.append(v)
            best.append((-quality, body))
            best.sort()
            del latest[: -t.most_bodies], best[t.most_bodies :]
        return ()

    rows = gallery.select("person_id", "body_id", "embedding", "crop_quality", "captured_at")
    return fold_in_order(rows, ["person_id"], ["captured_at", "body_id"], lambda: ([], []), step, "person_id bigint, body_id bigint", lambda key, state: [(key[0], k[1]) for k in state[1]])


def track_faces(samples: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """track, face_id of a track's faces that stay, in order: not a duplicate of one before, and with two before near to one of them.
    A fold holds the vectors of the faces that stay."""

    def step(kept: list, row: tuple) -> Iterable[tuple]:
        track, face, vector, _ = row
        v = unit(vector)
        top = max((k @ v for k in kept), default=-1.0)
        if top <= t.face_duplicate and (len(kept) < 2 or top >= t.face_contamination):
            kept.append(v)
            yield track, face

    rows = samples.select(F.col("track").alias("key"), "track", "face_id", "embedding", "captured_at")
    return fold_in_order(rows, ["key"], ["captured_at", "face_id"], list, step, "track bigint, face_id bigint")


def track_demographics(samples: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """track, gender (M if the mean margin is over the threshold), age (the median, half to even)."""
    return samples.groupBy("track").agg(F.when(F.avg("margin") > t.gender_margin, "M").otherwise("F").alias("gender"), F.bround(F.percentile("age", F.lit(0.5)), 0).cast("int").alias("age"))


def person_demographics(faces: DataFrame) -> DataFrame:
    """person_id, face_id, score: the row of the best face (the latest of ties)."""
    return faces.groupBy("person_id").agg(F.max_by("face_id", F.struct("face_score", "captured_at", "face_id")).alias("face_id"), F.max("face_score").alias("score"))


def staff_scores(sessions: DataFrame, staff_bodies: DataFrame, rows: int = 2048, persons: int = 256) -> DataFrame:
    """session_id, staff: the best median similarity of the session's vector to one staff person's bodies.

    Sessions and staff persons are dealt to blocks; every pair of blocks is one task's matrix product. A person's bodies, bounded by
    admission, lie in one block."""
    left, right = max(1, math.ceil(sessions.count() / rows)), max(1, math.ceil(staff_bodies.select("person_id").distinct().count() / persons))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asks = sessions.select(F.col("session_id").alias("asks"), V.doubles(F.col("embedding")).alias("v"), F.pmod(F.xxhash64("session_id"), F.lit(left)).alias("i"), every(right).alias("j"))
    known = staff_bodies.select(F.col("person_id").alias("known"), V.doubles(F.col("embedding")).alias("v"), F.pmod(F.xxhash64("person_id"), F.lit(right)).alias("j"), every(left).alias("i"))
    # no nulls among the ids: pandas would make them doubles
    both = asks.select("i", "j", F.col("asks").alias("id"), F.lit(True).alias("ask"), "v").union(known.select("i", "j", "known", F.lit(False), "v"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows.ask], rows[~rows.ask]
        if not len(a) or not len(b):
            return pd.DataFrame({"session_id": [], "staff": []})
        x, y = (np.stack(v.v.to_numpy()).astype(float) for v in (a, b))
        x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in (x, y))
        best = np.full(len(a), -1.0)
        for at in b.groupby("id").indices.values():
            best = np.maximum(best, np.median(x @ y[at].T, axis=1))
        return pd.DataFrame({"session_id": a.id, "staff": best})

    found = both.groupBy("i", "j").applyInPandas(compare, "session_id bigint, staff double")
    return cut(found.groupBy("session_id").agg(F.max("staff").alias("staff")), "staff")


FOLDED = "session_id bigint, person string, outcome string, place bigint, seen timestamp_ntz, embedding array<double>"


def islands(sessions: DataFrame, window_s: float) -> DataFrame:
    """sessions (session_id, start, end) with `island`, a number: a silence of over window_s before a start begins a new one.

    Running ends are found within each hour and carried over the hours, so that an hour's rows are one window and hours are a small table."""
    inside = Window.partitionBy("hour").orderBy("start", "session_id").rowsBetween(Window.unboundedPreceding, -1)
    before = sessions.withColumn("hour", F.date_trunc("hour", "start").cast("timestamp_ntz")).withColumn("until", F.max("end").over(inside))
    over = lambda: Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)  # noqa: E731  a row for each hour
    carried = before.groupBy("hour").agg(F.max("end").alias("last")).withColumn("carried", F.max("last").over(over())).select("hour", "carried")
    runs = before.join(F.broadcast(carried), "hour").withColumn("until", F.greatest("until", "carried"))
    opened = runs.withColumn("opens", (F.col("until").isNull() | (seconds_between(F.col("until"), F.col("start")) > window_s)).cast("int"))
    base = opened.groupBy("hour").agg(F.sum("opens").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(over()), F.lit(0))).select("hour", "base")
    island = F.sum("opens").over(Window.partitionBy("hour").orderBy("start", "session_id")) + F.col("base")
    return opened.join(F.broadcast(base), "hour").withColumn("island", island).select(*sessions.columns, "island")


def replay(sessions: DataFrame, staff_bodies: DataFrame, t: Thresholds = DEFAULTS, most: int = 20_000, root: str | None = None) -> DataFrame:
    """session_id, person, outcome (attached, created, left) of unassigned sessions (session_id, start, end, quality, embedding) in order of time, galleries growing.

    Only customers seen in the last recent_minutes can be attached to, so time falls into islands with longer silence between them; each
    island is folded on its own, holding the customers of the window. Staff do not change meanwhile, so every session's nearest staff person is found
    before the fold. An island of over `most` sessions is folded in slices of time, one after the other; the customers of the last minutes are
    saved with each slice, under root, so that a lost task redoes a slice and a stopped run with the same root and sessions goes on after the last one."""
    window, spark = 60.0 * t.recent_minutes, sessions.sparkSession
    root = root or new_path(spark, "replay")
    scored = sessions.join(staff_scores(sessions, staff_bodies), "session_id", "left")
    placed = cut(islands(scored, window).select("island", "session_id", "start", "end", "quality", "embedding", "staff"), "islands")
    long = [r.island for r in placed.groupBy("island").count().filter(F.col("count") > most).select("island").collect()]  # total / most at most

    def step(people: dict[str, list], row: tuple) -> Iterable[tuple]:
        session, start, end, quality, vector, staff, customer = row
        if customer is not None:  # saved by the slice before
            entry = people.setdefault(customer, [end, []])
            entry[1].append(vector)
            return
        v = unit(vector)
        for gone in [k for k, (seen, _) in people.items() if (start - seen).total_seconds() > window]:
            del people[gone]  # starts do not fall, so none of them comes back
        scores = sorted((-float(np.median(np.stack(vs) @ v)), k) for k, (_, vs) in people.items())
        nearest = -scores[0][0] if scores else -1.0
        person, outcome = None, "left"
        if scores and nearest >= t.body_recent and (len(scores) < 2 or scores[1][0] - scores[0][0] >= t.body_ambiguity):
            person, outcome = scores[0][1], "attached"
        elif quality >= t.create_body_quality and nearest < t.create_body_nearest and (-1.0 if staff is None else staff) < t.create_body_staff:
            person, outcome = f"new-{session}", "created"
        if person is not None:
            entry = people.setdefault(person, [end, []])
            entry[0] = max(entry[0], end)
            entry[1] = [*entry[1], v][-t.most_bodies :]
        yield session, person, outcome, None, None, None

    def saved(key: tuple, people: dict[str, list]) -> Iterable[tuple]:
        return [(key[0], person, "saved", i, seen, v) for person, (seen, vs) in people.items() for i, v in enumerate(vs)]

    def fold(rows: DataFrame, end=lambda key, people: ()) -> DataFrame:
        columns = ["island", "session_id", "start", "end", "quality", "embedding", "staff", "customer"]
        return fold_in_order(rows.select(*columns), ["island"], [F.col("customer").isNull(), "start", "session_id"], dict, step, FOLDED, end)

    fresh = placed.withColumn("customer", F.lit(None).cast("string"))
    decided = fold(fresh.filter(~F.col("island").isin(long)) if long else fresh)
    out = [decided]
    for island in long:
        own = fresh.filter(F.col("island") == island)
        micros = own.select(F.unix_micros(F.col("start").cast("timestamp")).cast("double").alias("at"))
        n = math.ceil(own.count() / most)
        cuts = sorted(set(micros.approxQuantile("at", [i / n for i in range(1, n)], 0.1 / n)))
        at_ = F.unix_micros(F.col("start").cast("timestamp")).cast("double")
        path = f"{root}/island={island}"
        for i, (low, high) in enumerate(zip([float("-inf"), *cuts], [*cuts, float("inf")], strict=True)):
            if not written(spark, f"{path}/slice={i}"):
                rows = own.filter((at_ >= low) & (at_ < high))
                if i:
                    kept = spark.read.schema(FOLDED).parquet(f"{path}/slice={i - 1}").filter("outcome = 'saved'")
                    # a saved customer's rows come first, in their order
                    rows = rows.unionByName(kept.select(F.lit(island).cast(own.schema["island"].dataType).alias("island"), F.col("place").alias("session_id"), F.col("seen").alias("start"), F.col("seen").alias("end"), F.lit(None).cast("double").alias("quality"), F.col("embedding").cast(own.schema["embedding"].dataType).alias("embedding"), F.lit(None).cast("double").alias("staff"), F.col("person").alias("customer")))
                fold(rows, saved).write.mode("overwrite").parquet(f"{path}/slice={i}")
            out.append(spark.read.schema(FOLDED).parquet(f"{path}/slice={i}"))
    every = out[0]
    for part in out[1:]:
        every = every.union(part)
    return every.filter("outcome <> 'saved'").select("session_id", "person", "outcome")
