"""Merging and cleaning of identities: duplicate pairs, vetoes, components, winners, remapped facts, galleries, contamination."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storepulse.functions import vectors as V
from storepulse.operators.components import connected_components
from storepulse.operators.folds import fold_in_order, unit
from storepulse.operators.intervals import overlapping_sessions, persons_within
from storepulse.operators.knn import gallery_pairs, nearest, similarity_to_galleries
from storepulse.operators.scopes import at
from storepulse.operators.windows import staff_rule
from storepulse.plans.lineage import cut, replaced
from storepulse.thresholds import DEFAULTS, Thresholds


def duplicate_pairs(faces: DataFrame, k: int = 5, least: float | None = None, t: Thresholds = DEFAULTS) -> DataFrame:
    """a < b (persons), sim: pairs of which a face of one is among the k nearest other-person faces of a face of the other."""
    own = faces.select(F.col("face_id").alias("query"), "person_id", "embedding")
    found = nearest(own, faces.select(F.col("face_id").alias("item"), "person_id", "embedding"), k, t.face_match if least is None else least, other_person=True)
    named = found.select("query", F.col("person_id").alias("other"), "sim").join(own.select("query", "person_id"), "query")
    return named.groupBy(F.least("person_id", "other").alias("a"), F.greatest("person_id", "other").alias("b")).agg(F.max("sim").alias("sim"))


def overlap_veto(pairs: DataFrame, sessions: DataFrame, as_of=None, t: Thresholds = DEFAULTS, closed: bool = False) -> DataFrame:
    """pairs (a, b) whose persons were not both on one camera for overlap_dedup_s (closed: at one instant) in the lookback."""
    if as_of is not None:
        sessions = sessions.filter(F.col("started_at") >= at(as_of) - F.expr(f"INTERVAL '{t.lookback_hours}' HOUR"))
    involved = pairs.select(F.explode(F.array("a", "b")).alias("person_id")).distinct()
    both = overlapping_sessions(sessions.join(involved, "person_id", "left_semi"), t.overlap_dedup_s, same_person=False, closed=closed)
    veto = both.select(F.least("person_a", "person_b").alias("a"), F.greatest("person_a", "person_b").alias("b")).distinct()
    return pairs.join(veto, ["a", "b"], "left_anti")


def winners(components: DataFrame, persons: DataFrame) -> DataFrame:
    """person_id, winner per member of a component: the highest face score, then the first seen, then the smallest id."""
    rows = components.select(F.col("node").alias("person_id"), "component").join(persons, "person_id")
    best = F.max_by("person_id", F.struct(F.coalesce("best_face_score", F.lit(-1.0)), -F.unix_micros(F.col("first_seen_at").cast("timestamp")), -F.col("person_id")))
    return rows.select("person_id", "component").join(rows.groupBy("component").agg(best.alias("winner")), "component").select("person_id", "winner")


def remap(facts: DataFrame, merges: DataFrame) -> DataFrame:
    """facts with each merged person replaced by the winner."""
    named = merges.select("person_id", "winner").distinct()
    return facts.join(named, "person_id", "left").withColumn("person_id", F.coalesce("winner", "person_id")).select(*facts.columns)


def merged_persons(persons: DataFrame, merges: DataFrame) -> DataFrame:
    """winner, visit_count, first_seen_at, last_seen_at, members of merged persons."""
    rows = persons.join(merges, "person_id")
    return rows.groupBy("winner").agg(F.sum("visit_count").alias("visit_count"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.count("*").alias("members"))


def gender_vote(sessions: DataFrame, merges: DataFrame, persons: DataFrame) -> DataFrame:
    """winner, gender: the majority of the cluster's session genders; on a tie or without any, the winner's own."""
    votes = sessions.select("person_id", "gender").join(merges, "person_id").groupBy("winner").agg(F.count_if(F.col("gender") == "M").alias("m"), F.count_if(F.col("gender") == "F").alias("f"))
    own = persons.select(F.col("person_id").alias("winner"), F.col("gender").alias("own"))
    every = merges.select("winner").distinct().join(votes, "winner", "left").join(own, "winner", "left")
    return every.select("winner", F.when(F.col("m") > F.col("f"), "M").when(F.col("f") > F.col("m"), "F").otherwise(F.col("own")).alias("gender"))


def merge_audit(merges: DataFrame, sims: DataFrame) -> DataFrame:
    """One row per loser: winner, loser, the best similarity of a pair that has it."""
    best = sims.select(F.explode(F.array("a", "b")).alias("person_id"), "sim").groupBy("person_id").agg(F.max("sim").alias("sim"))
    return merges.filter("person_id <> winner").join(best, "person_id").select(F.lit("merge").alias("kind"), "winner", F.col("person_id").alias("loser"), "sim")


def absorbed(gallery: DataFrame, merges: DataFrame, key: str, score: str, most: int, least: float, duplicate: float | None = None) -> DataFrame:
    """winner, key of the rows a merged cluster keeps: the winner's, then loser by loser (by id) its rows, best scored first, if they are no duplicates of
    the cluster and their median similarity to it, as it grows, is high enough. After each loser that gave rows, and at the end, the `most` best scored
    stay (ties: the smaller key), so that a fold holds these and what the loser at hand has given."""
    rows = gallery.filter("embedding IS NOT NULL").select("person_id", F.col(key).alias("k"), F.col(score).alias("s"), "embedding").join(merges, "person_id")

    def prune(kept: list) -> None:
        kept.sort(key=lambda x: x[:2])
        del kept[most:]

    def step(state: list, row: tuple) -> tuple:
        kept, at_hand, moved = state
        other, person, k, s, vector = row
        if other and person != at_hand:
            if moved:
                prune(kept)
            state[1:] = person, False
        v = unit(vector)
        if other and kept:
            sims = np.stack([x[2] for x in kept]) @ v
            if (duplicate is not None and sims.max() > duplicate) or np.median(sims) < least:
                return ()
        kept.append((-s, k, v))
        state[2] = state[2] or bool(other)
        return ()

    def end(group: tuple, state: list) -> list[tuple]:
        prune(state[0])
        return [(group[0], k) for _, k, _ in state[0]]

    placed = rows.select("winner", (F.col("person_id") != F.col("winner")).alias("other"), "person_id", "k", "s", "embedding")
    return fold_in_order(placed, ["winner"], ["other", "person_id", F.desc("s"), "k"], lambda: [[], None, False], step, f"winner bigint, {key} bigint", end)


class Medians:
    """The median similarity of each row of a gallery to the others, kept up as rows are removed.

    Every row has the others in order of similarity and a pointer to the lower middle of those that are left; a removal moves each pointer by one row
    that is left at most, so it costs the number of rows, not its square. Similarities are not kept, only their order: 4 bytes for each
    pair of rows (8 from 65,536 rows on), made a block at a time."""

    def __init__(self, vectors: np.ndarray, block: int = 512):
        n = len(vectors)
        kind = np.uint16 if n < 1 << 16 else np.uint32
        self.x, self.left, self.alive = vectors, n, np.ones(n, dtype=bool)
        self.order, self.rank = np.empty((n, n), kind), np.empty((n, n), kind)
        for lo in range(0, n, block):
            sim = vectors[lo : lo + block] @ vectors.T
            sim[np.arange(len(sim)), np.arange(lo, lo + len(sim))] = np.inf  # itself comes last
            order = np.argsort(sim, axis=1, kind="stable")
            self.order[lo : lo + block] = order
            np.put_along_axis(self.rank[lo : lo + block], order, np.arange(n, dtype=kind)[None, :], axis=1)
        self.rows = np.arange(n)
        self.at = np.full(n, max(n - 2, 0) // 2)

    def _next(self, at: np.ndarray, rows: np.ndarray, way: int) -> np.ndarray:
        at = at + way
        gone = ~self.alive[self.order[rows, at]]
        while gone.any():
            at[gone] += way
            gone[gone] = ~self.alive[self.order[rows[gone], at[gone]]]
        return at

    def values(self) -> np.ndarray:
        """Rounded medians; infinite for rows that are gone."""
        rows = self.rows[self.alive]
        similar = lambda at: np.einsum("ij,ij->i", self.x[rows], self.x[self.order[rows, at]])
        middle = similar(self.at[rows])
        if self.left % 2:  # an even number of others
            middle = (middle + similar(self._next(self.at[rows], rows, 1))) / 2
        out = np.full(len(self.alive), np.inf)
        out[rows] = np.round(middle, 9)
        return out

    def remove(self, gone: int) -> None:
        others = self.left - 1
        self.alive[gone] = False
        self.left -= 1
        if others < 2:
            return
        rows = self.rows[self.alive]
        at, place = self.at[rows], self.rank[rows, gone].astype(np.int64)
        stays = (others - 2) // 2 == (others - 1) // 2  # whether the lower middle keeps its number
        right = place <= at if stays else np.zeros(len(rows), dtype=bool)
        back = np.zeros(len(rows), dtype=bool) if stays else place >= at
        for moved, way in ((right, 1), (back, -1)):
            if moved.any():
                self.at[rows[moved]] = self._next(at[moved], rows[moved], way)


def contaminated(gallery: DataFrame, key: str, score: str, least: float, stop: int) -> DataFrame:
    """person_id, key of rows to remove: again and again the row with the lowest median similarity to the others while that is under `least`,
    until fewer than `stop` are left. Of equal medians the best scored goes first, as the rows are ordered by score (ties: the smaller key).

    A person's gallery is folded in one task, as each removal rests on those before; 20,000 rows take under 3 GB. Null vectors are left out."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["s", "k"], ascending=[False, True])
        gone: list[int] = []
        if len(rows) > 1:
            x = np.stack([np.asarray(v, dtype=float) for v in rows.embedding])
            medians = Medians(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))
            while medians.left >= max(stop, 2):
                values = medians.values()
                worst = int(np.argmin(values))
                if values[worst] >= least:
                    break
                gone.append(worst)
                medians.remove(worst)
        return pd.DataFrame({"person_id": [rows.person_id.iloc[0]] * len(gone), "k": [rows.k.iloc[i] for i in gone]})

    rows = gallery.filter("embedding IS NOT NULL").select("person_id", F.col(key).alias("k"), F.col(score).alias("s"), "embedding")
    return rows.groupBy("person_id").applyInPandas(fold, "person_id bigint, k bigint").withColumnRenamed("k", key)


def first_come_losers(conflicts: DataFrame, most: int = 50_000) -> DataFrame:
    """node of the conflicts (first, then: node ids, first coming before then) that a walk in order drops: it keeps a node unless one that it kept
    conflicts with it. The same is found in rounds: nodes that come before all undecided nodes in conflict with them stay, and those go.

    Each round is cut. What is left after a round with at most `most` conflicts is walked by one task, which that number bounds. Conflicts must not go round."""
    edges, gone = cut(conflicts.select("first", "then").distinct(), "conflicts"), []
    count = edges.count()
    while count > most:
        keep = edges.select(F.col("first").alias("node")).distinct().join(edges.select(F.col("then").alias("node")), "node", "left_anti")
        lost = cut(edges.join(keep.withColumnRenamed("node", "first"), "first", "left_semi").select(F.col("then").alias("node")).distinct(), "lost")
        gone.append(lost)
        edges = replaced(edges.join(lost.withColumnRenamed("node", "first"), "first", "left_anti").join(lost.withColumnRenamed("node", "then"), "then", "left_anti").select("first", "then"), edges, "conflicts")
        count = edges.count()

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        ahead: dict[int, list[int]] = {}
        behind: dict[int, int] = {}
        for first, then in zip(rows["first"], rows["then"], strict=True):
            ahead.setdefault(first, []).append(then)
            behind[then] = behind.get(then, 0) + 1
        ready, lost = [n for n in ahead if not behind.get(n)], set()
        while ready:
            node = ready.pop()
            for then in ahead.get(node, ()):
                if node not in lost:
                    lost.add(then)
                behind[then] -= 1
                if not behind[then]:
                    ready.append(then)
        return pd.DataFrame({"node": sorted(lost)}, dtype="int64")

    out = edges.groupBy().applyInPandas(walk, "node bigint")
    for lost in gone:
        out = out.union(lost)
    return out


def overlap_losers(sessions: DataFrame, least_s: float = 1.0, most: int = 50_000) -> DataFrame:
    """session_id of sessions to orphan: of one person's overlapping sessions on a camera, the longest stay first (ties: the first, then the smaller
    id) and what overlaps them goes. Sessions without a person are left alone."""
    pairs = overlapping_sessions(sessions, least_s).select("a", "b")
    length = F.unix_micros(F.coalesce("ended_at", "last_seen_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    rank = sessions.select("session_id", F.struct((-length).alias("length"), F.col("started_at").alias("start"), "session_id").alias("rank"))
    named = pairs.join(rank.select(F.col("session_id").alias("a"), F.col("rank").alias("ra")), "a").join(rank.select(F.col("session_id").alias("b"), F.col("rank").alias("rb")), "b")
    before = F.col("ra") < F.col("rb")
    conflicts = named.select(F.when(before, F.col("a")).otherwise(F.col("b")).alias("first"), F.when(before, F.col("b")).otherwise(F.col("a")).alias("then"))
    return first_come_losers(conflicts, most).withColumnRenamed("node", "session_id")


def orphaned(sessions: DataFrame, losers: DataFrame) -> DataFrame:
    """sessions whose losers have no person."""
    gone = losers.select("session_id").distinct().withColumn("gone", F.lit(True))
    return sessions.join(gone, "session_id", "left").withColumn("person_id", F.when(F.col("gone").isNull(), F.col("person_id"))).select(*sessions.columns)


def person_stats(sessions: DataFrame) -> DataFrame:
    """person_id, first, last, visits, gender (the majority; null on a tie) of what sessions are left."""
    m, f = F.count_if(F.col("gender") == "M"), F.count_if(F.col("gender") == "F")
    return sessions.filter("person_id IS NOT NULL").groupBy("person_id").agg(F.min("started_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.count("*").alias("visits"), F.when(m > f, "M").when(f > m, "F").alias("gender"))


def mixed_tracks(sessions: DataFrame, vectors: DataFrame, faces: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """session_id, reason of a person's sessions that do not belong: overlapping, of the other gender than most of its time, or with a face that does not fit."""
    lost = overlap_losers(sessions)
    rest = orphaned(sessions, lost).filter("person_id IS NOT NULL")
    seconds = F.unix_micros(F.coalesce("ended_at", "last_seen_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    time = lambda g: F.sum(F.when(F.col("gender") == g, seconds).otherwise(0))
    major = rest.groupBy("person_id").agg(F.when(time("M") > time("F"), "M").when(time("F") > time("M"), "F").alias("major"))
    other = rest.join(major, "person_id").filter("gender <> major").select("session_id")
    fitting = rest.join(other, "session_id", "left_anti").select(F.col("session_id").alias("query"), "person_id").join(vectors.select(F.col("session_id").alias("query"), "embedding"), "query")
    bad = similarity_to_galleries(fitting, fitting, faces).filter(F.col("median") < t.face_contamination).select(F.col("query").alias("session_id"))
    return lost.select("session_id", F.lit("overlap").alias("reason")).union(other.select("session_id", F.lit("gender"))).union(bad.select("session_id", F.lit("face")))


def recent_neighbours(sessions: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """a < b (persons) with sessions at most recent_minutes apart."""
    return persons_within(sessions, 60.0 * t.recent_minutes)


def recent_merges(sessions: DataFrame, faces: DataFrame, bodies: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """a, b, how of recent neighbours to merge: never together on a camera, and with near faces (best, and median if there are enough pairs) or
    near bodies (median, two or more each) that no face contradicts."""
    # a person without vectors is merged with no one
    seen = sessions.join(faces.select("person_id").union(bodies.select("person_id")).distinct(), "person_id", "left_semi").select(*sessions.columns)
    pairs = cut(overlap_veto(recent_neighbours(seen, t), seen, t=t, closed=True), "pairs")
    f = gallery_pairs(pairs, faces).select("a", "b", F.col("best").alias("face"), F.col("median").alias("face_median"), F.col("n").alias("face_pairs"))
    b = gallery_pairs(pairs, bodies).select("a", "b", F.col("median").alias("body"))
    enough = bodies.groupBy("person_id").agg(F.count("*").alias("n")).filter(F.col("n") >= t.least_bodies)
    sized = pairs.join(enough.select(F.col("person_id").alias("a")), "a", "left_semi").join(enough.select(F.col("person_id").alias("b")), "b", "left_semi").withColumn("bodies", F.lit(True))
    rows = pairs.join(f, ["a", "b"], "left").join(b, ["a", "b"], "left").join(sized, ["a", "b"], "left")
    by_face = F.coalesce((F.col("face") >= t.face_recent) & ((F.col("face_pairs") < t.cluster_pairs) | (F.col("face_median") >= t.cluster_median_grey)), F.lit(False))
    by_body = F.coalesce(F.col("bodies") & (F.col("body") >= t.body_recent), F.lit(False)) & F.coalesce(F.col("face") >= t.face_contradiction, F.lit(True))
    return rows.withColumn("how", F.when(by_face, "face").when(by_body, "body")).filter("how IS NOT NULL").select("a", "b", "how")


def staff_fragments(sessions: DataFrame, persons: DataFrame, faces: DataFrame, bodies: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """fragment, staff of customers that are a piece of a staff member: recent neighbours, near bodies and a near face, the best staff not ambiguous."""
    staff = persons.select("person_id", "is_staff")
    # a person without bodies or without faces is no piece, and has none
    seen = sessions.join(bodies.select("person_id").distinct(), "person_id", "left_semi").join(faces.select("person_id").distinct(), "person_id", "left_semi").select(*sessions.columns)
    pairs = recent_neighbours(seen, t).join(staff.select(F.col("person_id").alias("a"), F.col("is_staff").alias("sa")), "a").join(staff.select(F.col("person_id").alias("b"), F.col("is_staff").alias("sb")), "b").filter("sa <> sb")
    pairs = cut(pairs, "pairs")
    f = gallery_pairs(pairs, faces).select("a", "b", F.col("best").alias("face"))
    b = gallery_pairs(pairs, bodies).select("a", "b", F.col("median").alias("body"))
    rows = pairs.join(b, ["a", "b"]).join(f, ["a", "b"]).filter((F.col("body") >= t.staff_body) & (F.col("face") >= t.staff_face))
    named = rows.select(F.when(F.col("sa"), F.col("b")).otherwise(F.col("a")).alias("fragment"), F.when(F.col("sa"), F.col("a")).otherwise(F.col("b")).alias("staff"), "body")
    w = Window.partitionBy("fragment").orderBy(F.desc("body"), "staff")
    best = named.withColumn("rank", F.row_number().over(w)).withColumn("second", F.lead("body").over(w)).filter("rank = 1")
    return best.filter(F.col("second").isNull() | (F.col("body") - F.col("second") >= t.staff_ambiguity)).select("fragment", "staff")


def merge_map(pairs: DataFrame, persons: DataFrame) -> DataFrame:
    """person_id, winner of all persons that pairs (a, b) connect."""
    return cut(winners(connected_components(pairs), persons), "merges")


def without_persons(facts: DataFrame, gone: DataFrame, drop: bool) -> DataFrame:
    """facts without the gone persons' rows (drop), or with their person set to null."""
    if drop:
        return facts.join(gone.select("person_id"), "person_id", "left_anti").select(*facts.columns)
    mark = gone.select("person_id").distinct().withColumn("gone", F.lit(True))
    return facts.join(mark, "person_id", "left").withColumn("person_id", F.when(F.col("gone").isNull(), F.col("person_id"))).select(*facts.columns)


def faceless(persons: DataFrame, faces: DataFrame, sessions: DataFrame) -> DataFrame:
    """Persons without faces and, if there is one, the latest session with a crop."""
    crops = sessions.filter("best_crop_path IS NOT NULL AND person_id IS NOT NULL").groupBy("person_id").agg(F.max_by("best_crop_path", F.struct("started_at", "session_id")).alias("crop"))
    return persons.join(faces.select("person_id"), "person_id", "left_anti").join(crops, "person_id", "left").select("person_id", "crop")


def revalidated_staff(persons: DataFrame, sessions: DataFrame, start, end, t: Thresholds = DEFAULTS) -> DataFrame:
    """person_id, verdict (keep, demote), reason of staff seen in the range."""
    seen = sessions.filter(F.col("started_at").between(at(start), at(end))).select("person_id")
    staff = persons.filter("is_staff").join(seen, "person_id", "left_semi")
    still = staff_rule(sessions, persons, t).withColumn("rule", F.lit(True))
    rows = staff.join(still, "person_id", "left")
    reason = F.when(F.col("rule"), "rule").when(~F.col("has_face"), "no_face").otherwise("too_few_days")
    return rows.select("person_id", F.when(F.col("rule"), "keep").otherwise("demote").alias("verdict"), reason.alias("reason"))


def detached_tracks(sessions: DataFrame, vectors: DataFrame, bodies_of: DataFrame, faces: DataFrame, bodies: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """session_id, reason of sessions with five frames or more whose vectors are far from their person's gallery: faces from two rows, bodies from three."""
    rows = sessions.filter("person_id IS NOT NULL AND total_frames >= 5").select(F.col("session_id").alias("query"), "person_id")
    face = rows.join(vectors.select(F.col("session_id").alias("query"), "embedding"), "query")
    body = rows.join(bodies_of.select(F.col("session_id").alias("query"), "embedding"), "query")
    by_face = similarity_to_galleries(face, face, faces).filter((F.col("n") >= 2) & (F.col("best") < t.face_contradiction)).select("query", F.lit("face").alias("reason"))
    by_body = similarity_to_galleries(body, body, bodies).filter((F.col("n") >= 3) & (F.col("best") < t.body_contamination)).select("query", F.lit("body").alias("reason"))
    return by_face.union(by_body).groupBy(F.col("query").alias("session_id")).agg(F.max("reason").alias("reason"))


def recomputed(stored: DataFrame, again: DataFrame, key: str, least: float) -> DataFrame:
    """key, sim, low: the similarity of each stored vector to the one computed again (key, embedding), low under `least`. Rows without the other are left out."""
    both = stored.select(key, "embedding").join(again.select(key, F.col("embedding").alias("again")), key)
    sim = V.cosine(F.col("embedding"), F.col("again"))
    return both.select(key, sim.alias("sim"), (sim < least).alias("low"))


def duplicate_report(pairs: DataFrame, faces: DataFrame, sessions: DataFrame) -> DataFrame:
    """pairs with each person's faces and sessions, counted before joining."""
    f = faces.groupBy("person_id").agg(F.count("*").alias("faces"))
    s = sessions.filter("person_id IS NOT NULL").groupBy("person_id").agg(F.count("*").alias("sessions"))
    out = pairs
    for c in "ab":
        out = out.join(f.select(F.col("person_id").alias(c), F.col("faces").alias(f"faces_{c}")), c, "left").join(s.select(F.col("person_id").alias(c), F.col("sessions").alias(f"sessions_{c}")), c, "left")
    return out.select("a", "b", "sim", *(F.coalesce(f"{n}_{c}", F.lit(0)).alias(f"{n}_{c}") for n in ("faces", "sessions") for c in "ab"))
