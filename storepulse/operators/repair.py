"""Repair of billing visits: null persons, stitched sessions, visit clusters, inserted rows, audit."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storepulse.functions.json_fields import dwell_seconds
from storepulse.functions.scalars import seconds_between
from storepulse.operators.folds import fold_in_order, whole_groups
from storepulse.operators.intervals import epoch, gap_seconds, near_pairs, spans
from storepulse.operators.knn import median_to_all, similarity_to_galleries
from storepulse.operators.scopes import at
from storepulse.operators.windows import visits
from storepulse.plans.lineage import cut
from storepulse.thresholds import DEFAULTS, Thresholds

DWELL_EVENTS = ("zone_dwell", "zone_exit", "billing_interaction", "possible_purchase")


def fill_null_persons(facts: DataFrame, sessions: DataFrame, ts: str | None = None, as_of=None, hours: int | None = None) -> DataFrame:
    """facts with a null person taken from their session; with a lookback only in its hours. A known person stays."""
    own = sessions.select("session_id", F.col("person_id").alias("session_person"))
    fresh = F.lit(True) if hours is None else F.col(ts) >= at(as_of) - F.expr(f"INTERVAL '{hours}' HOUR")
    out = facts.join(own, "session_id", "left")
    return out.withColumn("person_id", F.coalesce("person_id", F.when(fresh, F.col("session_person")))).select(*facts.columns)


def fill_counts(facts: DataFrame, sessions: DataFrame) -> DataFrame:
    """A dry run: rows without person, and those that would gain one."""
    own = sessions.select("session_id", F.col("person_id").alias("session_person"))
    return facts.join(own, "session_id", "left").agg(F.count_if(F.col("person_id").isNull()).alias("without_person"), F.count_if(F.col("person_id").isNull() & F.col("session_person").isNotNull()).alias("would_gain"))


def zone_dwell_by_session(events: DataFrame, zones=None) -> DataFrame:
    """session_id, zone_id, dwell: the largest dwell that the dwell events of a session tell."""
    rows = events.filter(F.col("event_type").isin(*DWELL_EVENTS)).select("session_id", "zone_id", dwell_seconds(F.col("metadata")).alias("dwell"))
    return rows.filter("dwell IS NOT NULL AND session_id IS NOT NULL").groupBy("session_id", "zone_id").agg(F.max("dwell").alias("dwell"))


def stitch_candidates(sessions: DataFrame, staff: DataFrame, gap_s: float = 30.0) -> DataFrame:
    """orphan, neighbour, person_id, gap: sessions without person and non-staff sessions of their camera at most gap_s away that do not overlap them."""
    one = spans(sessions)
    known = one.filter("person_id IS NOT NULL").join(staff.select("person_id"), "person_id", "left_anti").select(*one.columns)
    pairs = near_pairs(one.filter("person_id IS NULL"), known, ["camera_id"], gap_s)
    gap = gap_seconds(*(F.col(c) for c in ("l.start", "l.end", "r.start", "r.end")))
    return pairs.select(F.col("l.session_id").alias("orphan"), F.col("r.session_id").alias("neighbour"), F.col("r.person_id").alias("person_id"), gap.alias("gap")).filter(F.col("gap") <= gap_s)


def stitch_persons(sessions: DataFrame, staff: DataFrame, gap_s: float = 30.0, width_s: float = 3600.0) -> DataFrame:
    """orphan, person_id of stitch_candidates(), without the neighbours: a pair may be given twice, for a person's sessions before and after.

    Orphans are dealt by camera and time, with the sessions that end at most gap_s before them or begin at most gap_s after; a task tells each of an orphan's
    persons once, so that pairs of sessions are never shuffled."""
    gap, width = round(gap_s * 1e6), round(max(gap_s, width_s) * 1e6)
    one = spans(sessions).select("session_id", "camera_id", "person_id", epoch(F.col("start")).alias("s"), epoch(F.col("end")).alias("e")).filter("camera_id IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL")
    known = one.filter("person_id IS NOT NULL").join(staff.select("person_id"), "person_id", "left_anti").select(*one.columns)
    orphans = one.filter("person_id IS NULL")
    place = lambda t: F.floor(t / width)

    def side(after: bool) -> DataFrame:
        own, low, high = (F.col("e"), F.col("s") - gap, F.col("s")) if after else (F.col("s"), F.col("e"), F.col("e") + gap)
        rows = orphans.withColumn("b", place(own)).unionByName(known.withColumn("b", F.explode(F.sequence(place(low), place(high)))))
        return rows.select(F.xxhash64("camera_id", "b", F.lit(after)).alias("task"), F.lit(after).alias("after"), F.col("person_id").isNull().alias("asks"), F.coalesce("person_id", F.lit(0)).alias("person"), "session_id", "s", "e")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in whole_groups(batches, "task"):
            c = {n: table.column(n).to_numpy() for n in ("asks", "person", "session_id", "s", "e")}
            o, k = ({n: v[own] for n, v in c.items()} for own in (c["asks"], ~c["asks"]))
            if not len(o["s"]) or not len(k["s"]):
                continue
            after = table.column("after")[0].as_py()
            key, begin = (k["s"], o["e"]) if after else (k["e"], o["s"] - gap)
            order = np.argsort(key, kind="stable")
            k, (names, code) = {n: v[order] for n, v in k.items()}, np.unique(k["person"][order], return_inverse=True)
            lo, hi = np.searchsorted(key[order], begin), np.searchsorted(key[order], begin + gap, side="right")
            each = np.cumsum(hi - lo)
            start = 0
            while start < len(lo):  # orphans with a million meetings at once, or one
                end = max(start + 1, int(np.searchsorted(each, (each[start - 1] if start else 0) + (1 << 20), side="right")))
                n = hi[start:end] - lo[start:end]
                row = np.repeat(np.arange(start, end), n)
                met = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]
                other = o["s"][row] - k["e"][met] if after else k["s"][met] - o["e"][row]
                told = np.unique((row * len(names) + code[met])[other <= gap])
                if len(told):
                    yield pa.RecordBatch.from_arrays([pa.array(o["session_id"][told // len(names)]), pa.array(names[told % len(names)])], ["orphan", "person_id"])
                start = end

    both = side(True).union(side(False))
    return both.repartition(F.xxhash64("task")).sortWithinPartitions("task").mapInArrow(meet, "orphan bigint, person_id bigint")


def stitch_scores(candidates: DataFrame, faces_of: DataFrame, bodies_of: DataFrame, faces: DataFrame, bodies: DataFrame, staff_bodies: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """orphan, person_id, has_face, face, body, staff_body of candidates (orphan, person_id), from the orphans' own vectors (session_id, embedding).

    face: the best similarity of the orphan's face to the person's; body: the median of its body's to the person's, if they are least_bodies or more;
    staff_body: the median to all bodies of staff. Null where a side has no vectors; an orphan without vectors keeps its candidates."""
    pairs = cut(candidates.select(F.col("orphan").alias("query"), "person_id").distinct(), "pairs")
    involved = pairs.select("query").distinct()
    own = lambda vectors: vectors.filter("embedding IS NOT NULL").select(F.col("session_id").alias("query"), "embedding").join(involved, "query", "left_semi")
    face, body = cut(own(faces_of), "faces"), cut(own(bodies_of), "bodies")
    having = lambda vectors: pairs.join(vectors.select("query").distinct(), "query", "left_semi")
    by_face = similarity_to_galleries(having(face), face, faces).select("query", "person_id", F.col("best").alias("face"))
    by_body = similarity_to_galleries(having(body), body, bodies).filter(F.col("n") >= t.least_bodies).select("query", "person_id", F.col("median").alias("body"))
    staff = median_to_all(body, staff_bodies).select("query", F.col("median").alias("staff_body"))
    seen = face.select("query").distinct().withColumn("has_face", F.lit(True))
    # few orphans have vectors: what is known is joined before it meets all pairs
    scores, told = by_face.join(by_body, ["query", "person_id"], "full"), seen.join(staff, "query", "full")
    rows = pairs.join(scores, ["query", "person_id"], "left").join(told, "query", "left")
    return rows.select(F.col("query").alias("orphan"), "person_id", F.coalesce("has_face", F.lit(False)).alias("has_face"), "face", "body", "staff_body")


def stitch(scored: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """orphan, person_id, how, reason from candidates (orphan, person_id, has_face, face, body, staff_body), one row a pair, as stitch_scores gives.

    A near staff body vetoes the orphan. A face under the lower bound rejects a candidate, one over the upper bound accepts it; a body over its own
    bound accepts it too if the orphan has no face, or one that does not reject. The best by face, then body (ties: the smaller person) is taken unless
    the second is too close: by body where the best has no accepting face, by face where both have. person_id and how are null for staff and no_match."""
    face, body = F.col("face"), F.col("body")
    strong, near = F.coalesce(face >= t.stitch_face_accept, F.lit(False)), F.coalesce(body >= t.stitch_body, F.lit(False))
    how = F.when(strong, "face").when(~F.col("has_face") & near, "body").when(F.coalesce(face >= t.stitch_face_reject, F.lit(False)) & near, "body_face_ok")
    w = Window.partitionBy("orphan").orderBy(F.desc("f"), F.desc("b"), "person_id")
    good = scored.withColumn("how", how).filter("how IS NOT NULL").withColumns({"f": F.coalesce(face, F.lit(-1.0)), "b": F.coalesce(body, F.lit(0.0))})
    ranked = good.withColumns({"rank": F.row_number().over(w), "f2": F.lead("f").over(w), "b2": F.lead("b").over(w)}).filter("rank = 1")
    one = (F.abs(F.col("b") - F.col("b2")) < t.stitch_body_ambiguity) & (F.col("f") < t.stitch_face_accept)
    both = (F.col("f") >= t.stitch_face_accept) & (F.col("f2") >= t.stitch_face_accept) & (F.abs(F.col("f") - F.col("f2")) < t.stitch_face_ambiguity)
    first = ranked.select("orphan", "person_id", "how", F.coalesce(one | both, F.lit(False)).alias("close"))
    orphans = scored.groupBy("orphan").agg(F.max("staff_body").alias("staff_body"))
    out = orphans.join(first, "orphan", "left").withColumn("vetoed", F.coalesce(F.col("staff_body") >= t.stitch_staff_veto, F.lit(False)))
    reason = F.when(F.col("vetoed"), "staff").when(F.col("how").isNull(), "no_match").when(F.col("close"), "ambiguous").otherwise("stitched")
    kept = lambda c: F.when(~F.col("vetoed"), F.col(c)).alias(c)
    return out.select("orphan", kept("person_id"), kept("how"), reason.alias("reason"))


def repaired_visits(sessions: DataFrame, dwell: DataFrame, staff: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """One row per visit of a person at a camera and zone with enough dwell in sum: its sessions, start, end, primary session (the largest dwell, the earliest of ties)."""
    one = spans(sessions).filter("person_id IS NOT NULL").join(dwell, "session_id")
    clusters = visits(one, t.visit_gap_s, ("person_id", "camera_id", "zone_id"))
    primary = F.max_by("session_id", F.struct(F.col("dwell"), -F.unix_micros(F.col("start").cast("timestamp")), -F.col("session_id")))
    out = clusters.groupBy("person_id", "camera_id", "zone_id", "visit").agg(F.min("start").alias("entered_at"), F.max("end").alias("exited_at"), F.sum("dwell").alias("dwell"), F.count("*").alias("n"), primary.alias("session_id"), F.sort_array(F.collect_list("session_id")).alias("sessions"))
    return out.filter(F.col("dwell") >= t.visit_dwell_s).join(staff.select("person_id"), "person_id", "left_anti")


def unsuppressed(found: DataFrame, billing: DataFrame, slack_s: float = 30.0) -> DataFrame:
    """Visits without billing of their person and zone: by one of their sessions, or within the visit and slack_s around. Then, in order of time,
    a visit within slack_s of one that is kept is suppressed too: an ordered fold per (person, zone) that holds the entries of one such stretch."""
    bills = billing.filter("person_id IS NOT NULL")
    key = ["person_id", "zone_id", "camera_id", "visit"]
    by_id = found.select(*key, F.explode("sessions").alias("session_id")).join(billing.select("session_id", "zone_id"), ["session_id", "zone_id"], "left_semi").select(*key).distinct()
    rest = found.join(by_id, key, "left_anti")
    left = rest.select(*key, F.col("entered_at").alias("start"), F.col("exited_at").alias("end"))
    right = bills.select("person_id", "zone_id", F.col("entered_at").alias("start"), F.col("entered_at").alias("end"))
    near = near_pairs(left, right, ["person_id", "zone_id"], slack_s).select(*(F.col(f"l.{k}").alias(k) for k in key)).distinct()
    rest = rest.join(near, key, "left_anti")
    slack = round(slack_s * 1e6)

    def choose(entries: deque, row: tuple) -> Iterable[tuple]:
        start, end, own = row
        while entries and entries[0] < start - slack:  # entries are in order, and starts do not fall: these suppress nothing any more
            entries.popleft()
        if not entries or entries[0] > end + slack:
            entries.append(start)
            yield (own,)

    named = cut(rest.withColumn("_id", F.monotonically_increasing_id()), "visits")
    at_ = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(f"_{c}")
    placed = named.select("person_id", "zone_id", at_("entered_at"), at_("exited_at"), "_id", F.col("session_id").alias("_session"))
    kept = fold_in_order(placed, ["person_id", "zone_id"], ["_entered_at", "_session"], deque, lambda e, r: choose(e, r[:3]), "_id bigint")
    return named.join(kept, "_id", "left_semi").select(*rest.columns)


def billing_rows(found: DataFrame) -> DataFrame:
    """New billing rows with ids hashed from what they are made of, so that a second run makes the same."""
    key = F.sha2(F.concat_ws("|", "person_id", "zone_id", "session_id", "entered_at"), 256)
    return found.select(key.alias("billing_id"), "camera_id", "person_id", "session_id", "zone_id", "entered_at", "exited_at", F.col("dwell").alias("dwell_seconds"), F.lit("repaired").alias("interaction_type"))


def event_rows(found: DataFrame, rules: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """The events of repaired visits, so that reports on events see them: ids hashed from what they are made of; the rule is the camera's or global
    enabled billing rule of the zone with the smallest id, null without one."""
    on = rules.filter("is_enabled AND rule_type = 'billing_interaction' AND zone_id IS NOT NULL").select("rule_id", "zone_id", F.col("camera_id").alias("of"))
    key = ["person_id", "zone_id", "camera_id", "session_id", "entered_at"]
    named = found.select(*key).join(F.broadcast(on), "zone_id").filter("of IS NULL OR of = camera_id").groupBy(*key).agg(F.min("rule_id").alias("rule_id"))
    rows = found.join(named, key, "left")
    event = F.sha2(F.concat_ws("|", F.lit("event"), "person_id", "zone_id", "session_id", "entered_at"), 256)
    meta = F.struct(
        F.col("dwell").alias("dwell_seconds"), F.lit(True).alias("billing_visit_repair"), F.lit("fragmented_visit_sum").alias("source"), F.col("n").alias("fragment_count"),
        F.col("sessions").alias("fragment_session_ids"), F.lit(t.visit_dwell_s).alias("dwell_threshold"), F.lit(t.visit_gap_s).alias("stitch_gap_seconds"),
    )
    told = F.concat(F.lit("Billing interaction (visit repair, "), F.bround("dwell", 0).cast("long"), F.lit("s across "), "n", F.lit(" fragments)"))
    no = F.lit(False)
    return rows.select(
        event.alias("event_id"), "camera_id", "rule_id", "zone_id", "person_id", "session_id", F.lit("billing_interaction").alias("event_type"), F.lit("Low").alias("severity"), told.alias("description"),
        F.to_json(meta).alias("metadata"), F.col("entered_at").alias("occurred_at"), no.alias("is_acknowledged"), no.alias("is_false_positive"),
    )


def audit_rows(found: DataFrame) -> DataFrame:
    return found.select(F.lit("billing_insert").alias("kind"), "person_id", "zone_id", "session_id", F.col("sessions").alias("fragment_session_ids"), F.col("n").alias("fragments"), "dwell")


def threshold_backfill(sessions: DataFrame, dwell: DataFrame, billing: DataFrame, least_s: float = 20.0) -> DataFrame:
    """Sessions with enough dwell in a zone and no billing for the two."""
    enough = dwell.filter(F.col("dwell") >= least_s)
    return enough.join(billing.filter("session_id IS NOT NULL").select("session_id", "zone_id"), ["session_id", "zone_id"], "left_anti").join(sessions.select("session_id", "camera_id", "person_id"), "session_id")


def closed_interactions(billing: DataFrame) -> DataFrame:
    """Dwell of closed interactions is exit - enter."""
    return billing.withColumn("dwell_seconds", F.when(F.col("exited_at").isNotNull(), seconds_between(F.col("entered_at"), F.col("exited_at"))).otherwise(F.col("dwell_seconds")))


def run_statistics(sessions: DataFrame, dwell: DataFrame, staff: DataFrame, billing: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """reason, n over sessions with dwell: no_person, staff, short, billed, candidate."""
    rows = sessions.join(dwell, "session_id")
    known = staff.select("person_id", F.lit(True).alias("staff"))
    bills = billing.filter("session_id IS NOT NULL").select("session_id", "zone_id").distinct().withColumn("billed", F.lit(True))
    rows = rows.join(known, "person_id", "left").join(bills, ["session_id", "zone_id"], "left")
    reason = F.when(F.col("person_id").isNull(), "no_person").when(F.col("staff"), "staff").when(F.col("billed"), "billed").when(F.col("dwell") < t.visit_dwell_s, "short").otherwise("candidate")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
